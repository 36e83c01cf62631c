"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of documents.  ``run`` writes each stage's result to the shared
work folder and reads it back, so that a lost executor costs a stage's tasks and no more.

A document whose lines all go as repeats is dropped with them; an empty one stays.  ``n_chars``
follows the text.  Mixing may give a document several times or not at all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm._common import materialize
from citelake.llm.linededup import without_repeats
from citelake.llm.minhash import without_near_copies
from citelake.llm.mixing import resampled
from citelake.llm.packing import packed
from citelake.llm.quality import accepted

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = without_repeats(docs).where((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors are at their largest here, after all other stages
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), lean=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
