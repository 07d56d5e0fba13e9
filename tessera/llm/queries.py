"""Queries of this subpackage and their SQL, by name."""

from tessera.llm import bpe, compaction, embed_dedup, hard_negatives, katz, licenses, line_dedup, minhash, mixing, pii, quality, substring_dedup, toxicity

_MODULES = [pii, minhash, substring_dedup, bpe, quality, mixing, katz, line_dedup, toxicity, embed_dedup, compaction, hard_negatives, licenses]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
