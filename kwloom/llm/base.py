"""Helpers the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

V = TypeVar("V")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="kwloom-llm-")
        _own[spark.sparkContext.applicationId] = found
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/kwloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(keys: DataFrame, rows: int = 250_000) -> DataFrame:
    """A stored table of keys for a semi or anti join: to every task while it has few rows.

    The other side then stays where it is; beyond that bound both sides are shuffled by key.
    """
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


class Sent(Generic[V]):
    """A value of bounded size on its way to all tasks; its class travels with it."""

    def __init__(self, spark: SparkSession, value: V) -> None:
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> V:
        """A copy, made anew at each call."""
        return pickle.loads(self._bytes.value)


def trim_memory(collect: bool = True) -> None:
    """Give what a task no longer needs back to the system: workers outlive their tasks."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """Let executors collect the garbage of finished work: a JVM keeps its heap until it does.

    Python workers of the next stage then find the memory that this one's shuffles took.
    """
    tasks = spark.sparkContext.defaultParallelism
    collected = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(collected.alias("done")).write.format("noop").mode("overwrite").save()


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return (F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds).cast("int")


def sample_ids(df: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """(id, class): at most ``per_class`` rows of each class, the first by a hash of the id.

    Counts of the classes give a bound on the hash that twice as many rows meet, so that the
    ranking sees a bounded number of rows whatever the size of the table or of a class.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(class_col).alias("_class")).where(
        F.col("_id").isNotNull() & F.col("_class").isNotNull()
    )
    share = F.coalesce(F.lit(2.0 * per_class + 50) / F.col("_n"), F.lit(1.0))
    sizes = F.broadcast(rows.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")))  # a row for each class
    rank = F.xxhash64(F.lit(7), "_id")
    order = Window.partitionBy("_class").orderBy(rank, "_id")
    return (
        rows.join(sizes, "_class").where((rank.cast("double") / 2.0**64 + 0.5) < share)
        .withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_class).select("_id", "_class")
    )


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text of each is ``limit`` bytes or a single row.

    What a batch took goes back to the system before the next one comes, and after the last.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        trim_memory(collect=False)
    trim_memory()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


class Carried:
    """Columns that pass an Arrow function unchanged, under names that clash with none."""

    def __init__(self, df: DataFrame, columns: Iterable[str] = ()) -> None:
        self.names = list(columns)
        self.inside = [f"_carried_{i}" for i in range(len(self.names))]
        self.columns = [df[f"`{c}`"].alias(n) for c, n in zip(self.names, self.inside, strict=True)]
        types = {f.name: f.dataType for f in df.schema}
        self.fields = [T.StructField(n, types[c]) for c, n in zip(self.names, self.inside, strict=True)]

    def restored(self) -> list[Column]:
        return [F.col(n).alias(c) for c, n in zip(self.names, self.inside, strict=True)]
