"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bitslice, bpe, filters, fim, jaccard, licenses, mixing, quality, secrets, templates, token_counts, toxicity

QUERIES = {
    "op1_bitslice": bitslice.query,
    "op2_lines": templates.query,
    "op3_bpe": bpe.query,
    "op4_ann": ann.query,
    "op5_secrets": secrets.query,
    "op6_licenses": licenses.query,
    "op7_toxicity": toxicity.query,
    "op8_jaccard": jaccard.query,
    "op9_quality": quality.query,
    "op10_mixing": mixing.query,
    "op11_fim": fim.query,
    "op12_filters": filters.query,
    "op13_token_counts": token_counts.query,
}

ORACLES = {
    "op1_bitslice": bitslice.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_fim": fim.ORACLE,
    "op12_filters": filters.ORACLE,
}
