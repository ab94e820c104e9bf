"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from . import bpe, chat, decontaminate, iblt, negatives, records, resample, rules, simhash, substring, suffix_tree, toxicity, warc

QUERIES = {
    "op1_suffix_tree": suffix_tree.op1_suffix_tree,
    "op2_content_archive": warc.op2_content_archive,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_rule_ensemble": rules.op4_rule_ensemble,
    "op5_repeated_units": substring.op5_repeated_units,
    "op6_simhash_golay": simhash.op6_simhash_golay,
    "op7_paragraph_sketches": iblt.op7_paragraph_sketches,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_record_files": records.op10_record_files,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_chat_format": chat.op12_chat_format,
    "op13_importance_resampling": resample.op13_importance_resampling,
}

SQL = {
    "op2_content_archive": warc.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_chat_format": chat.SQL,
    "op13_importance_resampling": resample.SQL,
}
