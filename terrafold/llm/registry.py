"""The subpackage's queries and their SQL."""

from . import bpe, html, jaccard, packing, quality, repeats, suffixtree, topk, toxicity, warc

_QUERIES = {
    "op1_suffix_tree": suffixtree.query,
    "op2_host_quality": quality.query,
    "op3_substring_dedup": repeats.query,
    "op4_warc": warc.query,
    "op5_byte_bpe": bpe.query,
    "op6_toxicity": toxicity.query,
    "op7_exact_topk": topk.query,
    "op10_jaccard_join": jaccard.query,
    "op9_main_text": html.query,
    "op8_best_fit_packing": packing.query,
}
_SQL = {
    "op3_substring_dedup": repeats.SQL,
    "op4_warc": warc.SQL,
    "op7_exact_topk": topk.SQL,
    "op2_host_quality": quality.SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
