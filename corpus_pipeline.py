"""Documents to packed training sequences, in five stages of strataforge.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the shared folder and reread as the next one's docs. All but the last return the columns of
documents. Each stage works on all rows its predecessor kept, and thresholds, fingerprints,
targets and packing are computed anew from them. The last stage's rows hold the token ids, so
the sequences can be built from them alone; row_id tells the copies of one document apart.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm import op2_simhash, op4_pii, op5_quality, op6_mix, op10_pack
from strataforge.llm._common import Scratch, table

#: Near-duplicates: shingles of five words and a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, MIN_SIMILARITY = 5, 0.8
_LEFT: dict[tuple[str, int], Scratch] = {}


def fresh(spark: SparkSession) -> Scratch:
    """A stage's scratch tables. Those of the stage before, in this thread, go: its result has been written by now."""
    key = (spark.sparkContext.applicationId, threading.get_ident())
    if key in _LEFT:
        _LEFT.pop(key).drop_all()
    _LEFT[key] = Scratch(spark)
    return _LEFT[key]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_quality.filter_quality(docs, scratch=fresh(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_simhash.drop_near_duplicates(docs, scratch=fresh(spark), width=SHINGLE_WORDS, min_similarity=MIN_SIMILARITY)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fresh(spark)
    return op4_pii.redact_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_mix.mix(docs, scratch=fresh(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_pack.pack_documents(docs, with_ids=True, scratch=fresh(spark))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("pii", pii),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SimHash, the span model and Pareto sampling can't be put into SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    fresh(spark)
    return docs
