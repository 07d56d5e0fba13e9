"""From documents to token ids in five stages, each written as Parquet and read again by the next.

quality rules: documents that fail go. line dedup: repeated multi-line chunks go, the documents stay. near dedup: one
document of each group stays. mixing: each document as often as its source's share asks for. encoding: ids and round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import stage_encode
from tessera.llm.common import Stash, table
from tessera.llm.line_dedup import stage_lines
from tessera.llm.minhash import stage_near_dedup
from tessera.llm.mixing import stage_mix
from tessera.llm.quality import stage_quality

STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("near_dedup", stage_near_dedup),
    ("mix_sources", stage_mix),
    ("encode", stage_encode),
]

#: Near-duplicate components and byte-level BPE have no SQL form; tests/llm compare the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    stash, docs = Stash(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
