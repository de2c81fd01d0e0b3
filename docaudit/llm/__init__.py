"""Operators for training data. QUERIES and ORACLES name one query for each."""

from . import (
    op01_packing,
    op02_langid,
    op03_bpe,
    op04_sharding,
    op05_topk,
    op06_ann,
    op07_chat,
    op08_quality,
    op09_jaccard,
    op10_lines,
    op11_repair,
    op12_negatives,
    op13_words,
)

MODULES = (op01_packing, op02_langid, op03_bpe, op04_sharding, op05_topk, op06_ann, op07_chat, op08_quality, op09_jaccard, op10_lines, op11_repair, op12_negatives, op13_words)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
