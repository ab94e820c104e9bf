"""Quality by a sparse ensemble of rules over text statistics.

Statistics of a text are Spark columns. Shallow trees are grown in numpy on a bounded labelled sample of them;
every path from a root is a conjunctive rule; a lasso logistic regression keeps few of the rules, and those
are compiled into one Spark column expression, so scoring all texts runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: At most so many labelled rows are learned from, those whose hashed id is least.
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAF, CUTS = 80, 3, 20, 24
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text column, all defined for null and empty texts. Counts are shares of what they are
    counted in."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.split(t, " ")
    lines = F.split(t, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    rare = F.length(F.translate(t, "|{}[]<>*&%$#@^~=_\\/+!", ""))
    return {
        "chars": F.length(t).cast("double"),
        "words": n_words.cast("double"),
        "lines": n_lines.cast("double"),
        "word_chars": chars / n_words,
        "line_words": n_words / n_lines,
        "upper": F.regexp_count(t, F.lit("[A-Z]")) / chars,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / chars,
        "symbols": (chars - F.greatest(rare, F.lit(0))) / chars,
        "bars": (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))) / n_words,
        "shouts": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) / n_words,
        "stops": (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))) / n_words,
        "commas": (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
    }


@dataclass
class Rules:
    """``rules``: (weight, [(statistic, "<=" or ">", cut), ...]); ``bias``; the score is their logistic sum."""

    bias: float
    rules: list[tuple[float, list[tuple[str, str, float]]]]


def _grow(x, y, cuts, rng, path, out, depth):
    """Adds the paths of a tree over the rows ``x`` to ``out``; each split is the best of a random half of the
    statistics by Gini impurity."""
    import numpy as np

    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return
    best = None
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        left = x[:, f][:, None] <= cuts[f][None, :]
        n1, p1 = left.sum(axis=0), (left & (y[:, None] > 0)).sum(axis=0)
        n2, p2 = len(y) - n1, y.sum() - p1
        fits = (n1 >= LEAF) & (n2 >= LEAF)
        if fits.any():
            impurity = np.where(fits, p1 * (1 - p1 / np.maximum(n1, 1)) + p2 * (1 - p2 / np.maximum(n2, 1)), np.inf)
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0]:
                best = impurity[k], int(f), float(cuts[f][k])
    if best is None:
        return
    _, f, cut = best
    under = x[:, f] <= cut
    for side, rows in (("<=", under), (">", ~under)):
        own = [*path, (f, side, cut)]
        out.add(tuple(sorted(own)))
        _grow(x[rows], y[rows], cuts, rng, own, out, depth - 1)


def _holds(x, rule):
    import numpy as np

    out = np.ones(len(x), bool)
    for f, side, cut in rule:
        out &= x[:, f] <= cut if side == "<=" else x[:, f] > cut
    return out


def fit(names: list[str], x, y, lasso: float = 2e-3, steps: int = 400, seed: int = 5) -> Rules:
    import numpy as np

    x, y = np.asarray(x, float).reshape(-1, len(names)), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Rules(float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(len(names))]
    found: set = set()
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 2000))
        _grow(x[rows], y[rows], cuts, rng, [], found, int(rng.integers(1, DEPTH + 1)))
    rules, columns, seen = [], [], set()
    for rule in sorted(found):
        h = _holds(x, rule)
        if LEAF <= h.sum() <= len(y) - LEAF and (key := h.tobytes()) not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(h)
    if not rules:
        share = y.mean()
        return Rules(float(np.log(share / (1 - share))), [])
    h = np.array(columns, dtype=np.float32).T
    mean, scale = h.mean(axis=0), h.std(axis=0)
    z = (h - mean) / scale
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b, u, ub, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        slope = (1 / (1 + np.exp(-np.clip(z @ u + ub, -30, 30))) - y) / len(y)
        nw = u - step * (z.T @ slope)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lasso, 0)
        nb = ub - step * slope.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    w = w / scale
    bias = float(b - (w * mean).sum())
    kept = [(float(w[k]), [(names[f], side, cut) for f, side, cut in rules[k]]) for k in np.flatnonzero(np.abs(w) > 1e-3)]
    return Rules(bias, kept)


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Rules:
    """Learns from rows of ``docs`` whose ids ``learn`` admits and which ``labels`` marks 0 or 1, at most
    ``rows`` of them: those of the least hashed ids, one row for each id, of several that of the least hashed text. An id
    marked both ways counts as 1; null texts count as empty. Only their statistics reach the driver. Without rows of both
    classes there are no rules and every text scores alike."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & learn).groupBy(id).agg(F.max(label).alias("y"))
    picked = F.broadcast(known.orderBy(F.xxhash64(id), id).limit(rows))
    own = docs.select(id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(picked, id)
    own = own.groupBy(id).agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
    stats = statistics(F.col("t"))
    sample = own.select(F.xxhash64(id).alias("o"), id, "y", *[c.alias(n) for n, c in stats.items()])
    found = sorted(sample.collect(), key=tuple)  # ``rows`` rows of numbers at most
    return fit(list(stats), [[r[n] for n in stats] for r in found], [r["y"] for r in found])


def score(docs: DataFrame, rules: Rules, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the column ``to`` (0 to 1) added, or replaced if there is one; other columns stay as they are, whatever
    their names. A null text scores like an empty one, a text of any length by all of it; rows are independent, so
    repeated rows score alike; an empty table gives an empty one."""
    stats, mark = statistics(F.col(text)), f"__{to}_"
    while any(c.startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    held = docs.withColumns({f"{mark}{n}": c for n, c in stats.items()})  # computed once, then read by all rules
    total = F.lit(rules.bias)
    for weight, conditions in rules.rules:
        holds = F.lit(True)
        for name, side, cut in conditions:
            c = F.col(f"{mark}{name}")
            holds = holds & ((c <= F.lit(cut)) if side == "<=" else (c > F.lit(cut)))
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return held.withColumn(to, F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).drop(*[f"{mark}{n}" for n in stats])


def op4_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored by rules learned from the labels that are not held out. Null and empty texts score
    alike, repeated rows each get their row, rows of a null id are never held out, an empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, train(docs, labels, ~held_out(5, 0)))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
