"""Synthetic notes from integer columns of orders: text that the detectors read back, with the
integers from which an oracle can tell what they must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEMPLATES = 12


def orders_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("doc_id"),
        k.alias("key"),
        (1 + k % 900).cast("int").alias("num"),
        (10 + k % 15).cast("int").alias("yy"),
        (1 + k % 3000).cast("int").alias("seq"),
        (1 + k % 97).cast("int").alias("para"),
        (k % TEMPLATES).cast("int").alias("template"),
    )


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows in a fixed number of partitions by ``key``, several for each core.  Reading a note takes far
    longer than moving its integers; by their bytes or a file's row groups a few tasks would read all notes."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, note_pos, key, text and the integers, one row for each order."""
    rows = spread(orders_numbers(spark, sf_dir), "doc_id")
    case = F.format_string("C-%d/%d", F.col("num"), F.col("yy"))
    year = F.col("yy") + 2000
    texts = [
        F.format_string("Judgment in Case C-%d/%d, ECLI:EU:C:%d:%d, paragraph %d.", "num", "yy", year, "seq", "para"),
        F.concat(F.lit("See "), case, F.lit(".")),
        F.format_string("Directive %d/%d/EU applies.", year, F.col("num")),
        F.format_string("Regulation (EC) No %d/%d, recital %d.", F.col("num"), F.lit(1990) + F.col("yy") % 10, F.col("para")),
        F.format_string("Article %d(%d) TFEU forbids it.", F.col("para"), F.lit(1) + F.col("num") % 3),
        F.format_string("Articles %d and %d of the Charter.", F.col("para"), F.col("para") + 1),
        F.format_string("Commission Decision in AT.%d, recital %d.", F.lit(30000) + F.col("num"), F.col("para")),
        F.format_string("Joined Cases C-%d/%d and C-%d/%d, paras %d–%d.", "num", "yy", F.col("num") + 1, F.col("yy"), F.col("para"), F.col("para") + 2),
        F.format_string("Opinion of Advocate General Kokott in Case C-%d/%d, ECLI:EU:C:%d:%d, point %d.", "num", "yy", year, "seq", "para"),
        F.format_string("Order of the Court in Case C-%d/%d, EU:C:%d:%d.", "num", "yy", year, "seq"),
        F.format_string("Decision C(%d) %d, not published.", year, F.col("seq")),
        F.format_string("Ibid., paragraph %d.", F.col("para")),
    ]
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(F.col("template") == i, t).otherwise(text)
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
    return rows.withColumn("note_pos", position).withColumn("text", text)


#: The same numbers for DuckDB.
NUMBERS_SQL = """
numbers AS (
  SELECT o_custkey AS doc_id, o_orderkey AS key, CAST(1 + o_orderkey % 900 AS INTEGER) AS num,
         CAST(10 + o_orderkey % 15 AS INTEGER) AS yy, CAST(1 + o_orderkey % 3000 AS INTEGER) AS seq,
         CAST(1 + o_orderkey % 97 AS INTEGER) AS para, CAST(o_orderkey % 12 AS INTEGER) AS template,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS note_pos
  FROM orders)
"""
