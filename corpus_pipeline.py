"""The corpus pipeline: quality rules, line dedup, near copies, source mixing, BPE; each stage on all that the last kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, line_dedup, mixing, ngram_join, quality
from tracelake.llm.registry import _tokenizer
from tracelake.sources.shared import shared_dir
from tracelake.sources.tables import table

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.keep_good(docs, table(spark, sf_dir, "labels"))),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup.dedup_lines(docs)),
    ("ngram_jaccard_join", lambda spark, docs, sf_dir: ngram_join.drop_near_copies(docs)),
    ("source_mixing", lambda spark, docs, sf_dir: mixing.mix_documents(docs)),
    ("byte_bpe", lambda spark, docs, sf_dir: bpe.round_trip(docs, *_tokenizer())),
]

#: SQL cannot express near copies, certified cutoffs and BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
