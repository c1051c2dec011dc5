"""The contract queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from inkwell.llm import base_queries, bpe, jaccard, media, mixing, pii, quality, secrets, suffixes, superkmer, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_media": media.op2_media,
    "op3_pii": pii.op3_pii,
    "op4_quality": quality.op4_quality,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_secrets": secrets.op6_secrets,
    "op7_urls": urls.op7_urls,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_bpe": bpe.op9_bpe,
    "op10_superkmer": superkmer.op10_superkmer,
    **base_queries.QUERIES,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op5_jaccard": jaccard.ORACLE_SQL,
    "op7_urls": urls.ORACLE_SQL,
    "op8_suffixes": suffixes.ORACLE_SQL,
    "op10_superkmer": superkmer.ORACLE_SQL,
    **base_queries.ORACLE_SQL,
}
