"""Helpers shared by the corpus operators: the shared work folder, materialised
tables and gapless ranks that never pull a group into one task."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a task's Parquet writer holds at once.
ROW_GROUP = 16 << 20
#: Rows with whole texts that Python is given at once.
TEXTS = 1000

_written: list[tuple[SparkSession, str]] = []
_remembered: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What a process keeps for its next tasks, made by ``make``; one thing at a time.  Workers
    outlive stages, so what one stage has left in them would be added to the memory of all later ones."""
    if name not in _remembered:
        if _remembered:
            _remembered.clear()
            give_back()
        _remembered[name] = make()
    return _remembered[name]


def give_back() -> None:
    """Return freed memory to the system.  Arrow and the C library else keep the most that a task ever took."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@functools.lru_cache(maxsize=1)
def _trim():
    """``malloc_trim``, or None where the C library has no such function."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    Only a local session, which has one machine, may do without: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + _local_dir()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


@functools.lru_cache(maxsize=1)
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="citelake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors, and is computed once.  A table so written stays as it is."""
    if getattr(df, "_work_path", None):
        return df
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        for path in {getattr(x, "_work_path", None) for x in (df, getattr(df, "_laid", df))} - {None}:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        # the session may already be gone at exit; each folder is tried
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made inside give Python at most ``rows`` rows at once: for rows that are blocks
    of vectors.  What is inside must be written there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for Python stages on whole texts: few texts in an Arrow batch, so that
    neither the executor's direct memory nor the worker's grows with long ones."""
    with batches_of(df.sparkSession, TEXTS):
        return materialize(df, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with a gapless long from 0 within each value of ``group``, by ``order``.

    Rows are range-partitioned by (group, order), so that a hot group spreads over
    many tasks, and each partition numbers its own rows.  Only the first group of a
    partition can have begun in an earlier one; so a partition has one offset, and as
    many rows are broadcast as there are partitions.  Ties are numbered in the order in
    which they lie in the written table.  Ranges are chosen from a sample of ``df``, which
    is therefore computed twice: give it a written table if it is dear.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(group, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_rank_part", T.IntegerType()), T.StructField("_rank_run", T.LongType()), T.StructField(name, T.LongType())])
    at = df.columns.index(group)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, run, count = None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(at)
            # a place where another group starts; nulls are a group
            codes = pa.concat_arrays([pa.array([last], values.type), values]).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = codes[1:] != codes[:-1]
            starts[0] |= run < 0
            runs = run + np.cumsum(starts)
            places = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, places, -1))
            rank = np.where(begin < 0, places + count, places - begin)
            last, run, count = values[n - 1].as_py(), int(runs[-1]), int(rank[-1]) + 1
            new = [pa.array(np.full(n, part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(rank.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=None, names=schema.names)

    laid = materialize(laid.mapInArrow(numbered, schema), "ranked")
    ends = laid.groupBy("_rank_part").agg(
        F.max("_rank_run").alias("runs"),
        F.min_by(F.struct(group), "_rank_run").alias("first"),
        F.max_by(F.struct(group), "_rank_run").alias("last"),
        F.max(F.struct("_rank_run", name)).alias("tail"),
    )
    # one row for each partition
    offsets, running, before = [], 0, None
    for r in ends.orderBy("_rank_part").select("_rank_part", "runs", "first", "last", F.col("tail")[name].alias("last_n")).collect():
        running = running if before is not None and r["first"] == before else 0
        offsets.append((r["_rank_part"], running))
        running = (running if r["runs"] == 0 else 0) + r["last_n"] + 1
        before = r["last"]
    columns = list(zip(*offsets, strict=True)) or [(), ()]
    # an Arrow table stays in the JVM, a list of rows would start Python workers
    table = spark.createDataFrame(pa.table({"_rank_part": pa.array(columns[0], pa.int32()), "_rank_before": pa.array(columns[1], pa.int64())}))
    joined = laid.join(F.broadcast(table), "_rank_part")
    rank = F.col(name) + F.when(F.col("_rank_run") == 0, F.col("_rank_before")).otherwise(0)
    out = joined.select(*df.columns, rank.alias(name))
    out._laid = laid
    return out


def sliced(batch: pa.RecordBatch, column: str, chars: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Pieces of an Arrow batch of about ``chars`` bytes of text, one row at least, so
    that a worker's memory is bounded by that and the longest text."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(lengths):
        if total and total + size > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(lengths):
        yield batch.slice(start)
