"""Encoding texts through a tokenizers model, one space-separated chunk at a time.

Both models used here treat what stands on the two sides of a single space separately: a space either
starts the next piece or is dropped, and no normalisation reaches across it; a single line end is a piece
of its own or is dropped. So a text can be cut at line ends and before spaces, and equal chunks, which make
up most of a corpus, need encoding once. Texts where white space touches white space go to the model whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Chunks remembered by one worker; the memory is emptied beyond it.
CACHE_CHUNKS = 200_000

#: Texts on which an encoder must agree with its model before it takes texts apart.
_PROBES = ["A line of words, and 12 numbers!\nNext line; it's «quoted» and-hyphenated.", "été Ärger straße naïve", "x", "two words", "tab\tand  blanks", "end.\n", "MiXed CASE 3.14 foo_bar", "日本 🙂 word"]
_TOUCHING = re.compile(r"\s\s")
_BEHIND = ".,;:!?*&%$#"
#: Chunks that lower-casing and composing leave at as many bytes: Latin letters, with no special token's mark.
_SAME_LENGTH = re.compile("[\x00-;=-\u012f\u0131-\u017f]+")


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, exactly as the model encodes whole texts.

    ``keep_space``: whether the space before a chunk belongs to it.
    """

    def __init__(self, path: str, keep_space: bool, specials_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = specials_as_text
        self.lead = " " if keep_space else ""
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes: a token has one character for each
        for token, i in vocab.items():
            self.sizes[i] = len(token.removesuffix("</w>"))
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.line_end = self._whole(["\n"])[0]
        self.apart = True
        self.apart = self.encode(_PROBES) == self._whole(_PROBES)  # another model may not allow it

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str], lead: str) -> dict[str, bytes]:
        """Ids of each chunk. Runs of chunks are encoded as one text, which costs the model far less than as
        many texts, and cut where the bytes of the tokens add up to those of the chunks."""
        import numpy as np

        plain = [x for x in chunks if _SAME_LENGTH.fullmatch(x)]
        found = {}
        for i in range(0, len(plain), 8192):
            part = plain[i : i + 8192]
            text = lead + " ".join(part)
            if self.lead and not lead:  # no white space may be added to chunks that start a line
                found.update(zip(part, self._whole(part)))
                continue
            if lead:
                ends = np.cumsum([len(x.encode()) + 1 for x in part])
            else:
                ends = np.cumsum([len("".join(x.split()).encode()) for x in part])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            bytes_before = np.concatenate([[0], np.cumsum(self.sizes[ids])])
            cuts = np.searchsorted(bytes_before, ends)
            if bytes_before[-1] != ends[-1] or (bytes_before[cuts] != ends).any():
                found.update(zip(part, self._whole([lead + x for x in part])))
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            found.update((x, raw[a:b]) for x, a, b in zip(part, [0, *cuts], cuts))
        others = list(set(chunks).difference(found))
        found.update(zip(others, self._whole([lead + x for x in others])))
        return found

    def _learn(self, new: set[str], cache: dict[str, bytes], lead: str) -> None:
        """Encodes ``new`` into ``cache``. Punctuation behind a letter is a piece of its own, so words with and
        without it need encoding once."""
        split = {}
        for x in new:
            core = x.rstrip(_BEHIND)
            if core and len(core) < len(x) and core[-1].isalpha():
                split[x] = core, x[len(core) :]
        cores = {c for c, _ in split.values()}.union(new.difference(split)).difference(cache)
        cache.update(self._chunks(list(cores), lead))
        tails = {t for _, t in split.values()}.difference(self.tails)
        self.tails.update(self._chunks(list(tails), ""))
        cache.update((x, cache[c] + self.tails[t]) for x, (c, t) in split.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.apart:
            return self._whole([t or "" for t in texts])
        parts: list[list[list[str]] | None] = []
        new: set[str] = set()
        heads: set[str] = set()
        for t in texts:
            if not t or _TOUCHING.search(t):
                parts.append(None)
                continue
            parts.append(lines := [x.split(" ") for x in t.split("\n")])
            for x in lines:
                new.update(x[1:])
                heads.add(x[0])
        if len(self.cache) + len(self.heads) + len(new) + len(heads) > CACHE_CHUNKS:
            self.cache.clear()
            self.heads.clear()
        self._learn(new.difference(self.cache), self.cache, self.lead)
        self._learn(heads.difference(self.heads), self.heads, "")
        rest, first, out = self.cache.__getitem__, self.heads.__getitem__, []
        for t, lines in zip(texts, parts):
            if lines is None:
                out.append(self._whole([t])[0] if t else b"")
            else:
                out.append(self.line_end.join([first(x[0]) + b"".join(map(rest, x[1:])) for x in lines]))
        return out


_LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ſ]+"
_LATIN = re.compile(_LETTERS)


class WordEncoder:
    """Ids of texts under a model that lower-cases and drops white space, exactly as it encodes whole texts.

    White space only parts pieces there, so texts are split into words, words into Latin letters and the
    punctuation behind them, and each distinct one of these is encoded once. Splitting and numbering run in
    Arrow and gathering in numpy; Python sees distinct pieces only. Latin letters come to the model lower-cased
    and composed already, so those skip its normalisation.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.model.model)  # the same vocabulary and merges in memory
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
        self._clear()
        self.apart = True
        ids, sizes = self.encode(pa.array(_PROBES))
        self.apart = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [self._whole(t).tolist() for t in _PROBES]

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.begins, self.sizes, self.pool = array("q"), array("q"), bytearray()

    def _whole(self, text: str):
        import numpy as np

        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _keep(self, pieces: list[str], ids, sizes) -> None:
        """Remembers the ids of new pieces, which follow each other in ``ids``."""
        import numpy as np

        begin = len(self.pool) // 4 + np.cumsum(sizes, dtype=np.int64) - sizes
        self.rows.update(zip(pieces, range(len(self.begins), len(self.begins) + len(pieces))))
        self.begins.frombytes(begin.tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.pool += ids.tobytes()

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        letters, others = [], []
        for x in pieces:
            (letters if _LATIN.fullmatch(x) else others).append(x)
        for i in range(0, len(letters), 8192):
            part = letters[i : i + 8192]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.closes[ids]) + 1  # letters are one piece: the last token closes it
            if len(cuts) == len(part):
                self._keep(part, ids, np.diff(cuts, prepend=0))
            else:
                others += part
        if others:
            found = [self._whole(x) for x in others]
            self._keep(others, np.concatenate(found), np.array([len(x) for x in found]))

    def encode(self, texts):
        """Of an Arrow array of strings: all ids (uint32), and how many each text has."""
        import numpy as np
        import pyarrow.compute as pc

        if not self.apart:  # another model may not allow texts to be taken apart
            found = [self._whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([*found, np.zeros(0, "<u4")]), np.array([len(x) for x in found], np.int64)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        coded = pc.list_flatten(lists).dictionary_encode()
        words = coded.dictionary
        core = pc.utf8_rtrim(words, characters=_BEHIND)
        lettered = pc.match_substring_regex(core, f"^{_LETTERS}$")
        first = pc.if_else(lettered, pc.utf8_lower(core), words)
        tail = pc.if_else(lettered, pc.replace_substring_regex(words, f"^{_LETTERS}", ""), "")
        pieces = [x.dictionary_encode() for x in (first, tail)]
        named = [x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in pieces]
        distinct = set().union(*named)
        if len(self.rows) + len(distinct) > CACHE_CHUNKS:
            self._clear()
        self._learn([x for x in distinct if x not in self.rows])
        pool, begins, sizes = np.frombuffer(bytes(self.pool), "<u4"), np.array(self.begins), np.array(self.sizes)

        def gathered(pool, begins, sizes):
            after = np.cumsum(sizes)
            total = int(after[-1]) if len(after) else 0
            return pool[np.repeat(begins - after + sizes, sizes) + np.arange(total)], after

        rows = [np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))[x.indices.to_numpy()] for own, x in zip(named, pieces)]
        both = np.stack(rows, axis=1).ravel()
        ids, after = gathered(pool, begins[both], sizes[both])  # of each distinct word
        after = after[1::2]
        size = np.diff(after, prepend=0)
        at = coded.indices.to_numpy()
        ids, after = gathered(ids, (after - size)[at], size[at])
        return ids, np.diff(np.concatenate([[0], after])[ends])
