"""Window-shaped operators: runs, eviction, restarts, orders, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: str, number: str, most: int | None = None) -> DataFrame:
    """Runs of successive distinct integers of each group: from, to."""
    order = Window.partitionBy(group).orderBy(number)
    island = rows.select(group, number).distinct().withColumn("_island", F.col(number) - F.row_number().over(order))
    out = island.groupBy(group, "_island").agg(F.min(number).alias("run_from"), F.max(number).alias("run_to")).drop("_island")
    if most is None:
        return out
    return out.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("run_from"))).where(F.col("_k") <= most).drop("_k")


def evicted(entries: DataFrame, shard: str, key: str, when: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """Entries beyond the newest ``most`` or beyond ``most_bytes`` of the newer ones, per
    shard of the store; sizes of doomed entries count as well."""
    order = Window.partitionBy(shard).orderBy(F.desc(when), key)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.withColumn("place", F.row_number().over(order)).withColumn("bytes_upto", F.sum(size).over(upto))
    return placed.where((F.col("place") > most) | (F.col("bytes_upto") > most_bytes))


def last_numbering(rows: DataFrame, group: str, position: str, number: str, least: int = 10) -> DataFrame:
    """The rows of the last run of each group that starts its numbers anew, if long enough."""
    order = Window.partitionBy(group).orderBy(position)
    before = F.lag(number).over(order)
    marked = rows.withColumn("_start", F.when(before.isNull() | (F.col(number) <= before), F.col(position)))
    last = Window.partitionBy(group)
    marked = marked.withColumn("_last", F.max("_start").over(last)).where(F.col(position) >= F.col("_last"))
    return marked.withColumn("_n", F.count("*").over(last)).where(F.col("_n") >= least).drop("_start", "_last", "_n")


def decision_order(rows: DataFrame, group: list[str], provisional: Column, language: Column, date: Column, tie: str) -> DataFrame:
    """Rank of decisions: provisional last, English, French, others, older first, undated last."""
    preference = F.when(language == "en", 0).when(language == "fr", 1).otherwise(2)
    order = Window.partitionBy(*group).orderBy(provisional.cast("int"), preference, date.asc_nulls_last(), tie)
    return rows.withColumn("rank", F.row_number().over(order))


def stratified(rows: DataFrame, stratum: str, key: str, seed: int, allocation: dict[str, int], otherwise: int) -> DataFrame:
    """A seeded sample of each stratum: the first by hash of seed and key."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    wanted = F.lit(otherwise)
    for name, n in allocation.items():
        wanted = F.when(F.col(stratum) == name, n).otherwise(wanted)
    placed = rows.withColumn("draw", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key)))
    return placed.where(F.col("draw") <= wanted)


def repeated(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """How often each value stands in its group, and whether more than once."""
    return rows.groupBy(*group, value).agg(F.count("*").alias("n")).withColumn("repeated", F.col("n") > 1)


def previous_established(rows: DataFrame, group: str, position: str, value: Column) -> DataFrame:
    """For each row the latest value established before it (as-of, nulls skipped)."""
    before = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("established", F.last(value, ignorenulls=True).over(before))
