"""Aggregates: targets, modes, shapes of misses, stratified estimates, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def targets(citations: DataFrame, identifier: str, note: str) -> DataFrame:
    """Distinct retrieval targets: first note and all notes."""
    return citations.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.min(note).alias("first_note"), F.array_sort(F.collect_set(note)).alias("notes"))


def mode_first_seen(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each group; among equals the one seen first, then the smallest."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    return counts.groupBy(group).agg(F.min_by(F.col(value), F.struct((-F.col("_n")).alias("_m"), "_first", value)).alias(value), F.max("_n").alias("n"))


def shapes(rows: DataFrame, text: Column, document: Column, top: int = 12) -> DataFrame:
    """Texts with digits as ``#``, upper case: count, documents, an example; the ``top`` most."""
    shaped = rows.select(F.upper(F.regexp_replace(text, "[0-9]", "#")).alias("shape"), text.alias("_text"), document.alias("_doc"))
    counts = shaped.groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("_doc").alias("documents"), F.min("_text").alias("example"))
    return counts.orderBy(F.desc("n"), "shape").limit(top)


def strata_totals(sample: DataFrame, population: DataFrame, stratum: str, value: Column) -> DataFrame:
    """Total of a value over all strata with finite-population correction: total, low, high."""
    per = sample.groupBy(stratum).agg(F.avg(value).alias("_mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("_var"), F.count("*").alias("_n"))
    joined = per.join(population, stratum)
    big, n = F.col("population").cast("double"), F.col("_n").cast("double")
    out = joined.agg(F.sum(big * F.col("_mean")).alias("total"), F.sum(big * big * (1 - n / big) * F.col("_var") / n).alias("_variance"))
    half = Z95 * F.sqrt("_variance")
    return out.select("total", (F.col("total") - half).alias("low"), (F.col("total") + half).alias("high"))


def strata_ratio(sample: DataFrame, population: DataFrame, stratum: str, num: Column, den: Column) -> DataFrame:
    """Combined ratio over strata, clamped to [0, 1]; no interval where a stratum has one row."""
    rows = sample.select(stratum, num.cast("double").alias("_num"), den.cast("double").alias("_den")).join(population, stratum)
    per = rows.groupBy(stratum, "population").agg(F.avg("_num").alias("_a"), F.avg("_den").alias("_b"))
    ratio = per.agg((F.sum(F.col("population") * F.col("_a")) / F.sum(F.col("population") * F.col("_b"))).alias("ratio"), F.sum(F.col("population") * F.col("_b")).alias("_x"))
    off = rows.join(F.broadcast(ratio)).groupBy(stratum, "population", "ratio", "_x").agg(F.var_samp(F.col("_num") - F.col("ratio") * F.col("_den")).alias("_var"), F.count("*").alias("_n"))
    big, n = F.col("population").cast("double"), F.col("_n").cast("double")
    out = off.groupBy("ratio", "_x").agg(F.sum(big * big * (1 - n / big) * F.col("_var") / n).alias("_variance"), F.min("_n").alias("_least"))
    half = F.when(F.col("_least") >= 2, Z95 * F.sqrt("_variance") / F.col("_x"))
    clamp = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return out.select("ratio", clamp(F.col("ratio") - half).alias("low"), clamp(F.col("ratio") + half).alias("high"))


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement of two markers and Cohen's kappa; 1 where chance alone would agree always."""
    p, q = F.avg(a.cast("double")), F.avg(b.cast("double"))
    out = rows.agg(F.avg((a == b).cast("double")).alias("agreement"), (p * q + (1 - p) * (1 - q)).alias("_chance"))
    return out.select("agreement", F.when(F.col("_chance") >= 1, F.lit(1.0)).otherwise((F.col("agreement") - F.col("_chance")) / (1 - F.col("_chance"))).alias("kappa"))


def only_of_group(rows: DataFrame, group: Column, name: str, value: str) -> DataFrame:
    """Groups that hold exactly one distinct value."""
    return rows.groupBy(group.alias(name)).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
