"""Shared helpers: the cluster's shared folder, written tables, Arrow batch slicing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session leaves that setting empty and the master is local (tests, one machine) a temporary folder of its own is set.
    """
    if found := spark.conf.get(CHECKPOINT_KEY, None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="crosspanel-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/crosspanel/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends here.

    The table is deleted by ``drop_written``, or when the driver's Python ends; until then lazy results may read it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    if not _paths:
        atexit.register(drop_written)
    _paths.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._crosspanel_path = path
    return back


_paths: list[tuple[SparkSession, str]] = []


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of these written tables, or of all: no result that is still to be computed may need them."""
    wanted = {t._crosspanel_path for t in tables}
    for spark, path in [x for x in _paths if not tables or x[1] in wanted]:
        _paths.remove((spark, path))
        with contextlib.suppress(Exception):  # the session may have ended
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hot_keys(df: DataFrame, key: str, rows: int = 200_000, share: int = 256, least: int = 20_000) -> list:
    """Keys that hold more than one in ``share`` rows of a written table, or of about ``rows`` of its rows: fewer than ``share`` keys, whatever the data.

    They only choose how ``keyed_join`` joins: what is joined does not hang on them.
    """
    n = df.count()
    if n < least:
        return []
    sample = df.select(key) if n <= rows else df.select(key).sample(rows / n, seed=1)
    counts = sample.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull() & (F.col("n") > min(n, rows) * 1.1 / share))
    return [r[0] for r in counts.limit(share).collect()]


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left``, a written table, joined (inner or left) to ``right``, which has one row a key. Hot keys meet their right rows by broadcast, fewer than
    256 of them, and all others by a shuffle, so no key's rows go to one task.
    """
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    named = left.sparkSession.createDataFrame([(k,) for k in hot], T.StructType([left.schema[key]]))
    hot_right = F.broadcast(right.join(F.broadcast(named), key, "left_semi"))
    return left.join(F.broadcast(named), key, "left_semi").join(hot_right, key, how).unionByName(left.join(F.broadcast(named), key, "left_anti").join(right, key, how))


def without_shuffle_files(spark: SparkSession) -> None:
    """Let Spark delete an action's shuffle files as soon as the action ends, as each step here writes its table."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that extra columns cannot clash with an operator's own."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*names)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return only(df, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text or binary column of each slice has about ``limit`` bytes, or is one row. A column of numbers tells the rows' sizes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held_in = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(held_in if pa.types.is_integer(held_in.type) else pc.binary_length(held_in), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers live on, and other operators run beside them."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def plain_strings(array: pa.Array) -> pa.Array:
    """A string array that starts at its buffers' beginning, whichever string type Spark sent."""
    return array.cast(pa.large_string()) if array.type != pa.large_string() else array
