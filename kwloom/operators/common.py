"""Helpers shared by the table operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="kwloom-")
        _own[spark.sparkContext.applicationId] = found
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back from there.

    The written table has columns and statistics, so later steps prune and size it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kwloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exploded(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of ``array`` next to the kept columns."""
    return df.select(*keep, F.explode(array).alias(name))


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate over a table, usable inside another query's expressions."""
    return df.agg(value.alias("value")).scalar()


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with the position of each row in the order of some columns, from 0.

    Rows are sorted in ranges and numbered inside them; a row a range says how many come before.
    """
    at, first = "_at", "_before"
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias(first)))  # a row for each range
    return placed.withColumn("_range", part).join(offsets, "_range").select(*df.columns, (F.col(first) + place).alias(name))


def top_per_group(df: DataFrame, keys: list, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; a large group is trimmed before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Whole row with the smallest ``order`` per key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def mode_per_group(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key; ties go to the smaller value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(out)
    )


def mean(col: Column | str) -> Column:
    """Average over exact decimal sums, so the result does not depend on row order."""
    value = F.col(col) if isinstance(col, str) else col
    return exact_sum(value) / F.count(value)


def exact_sum(col: Column | str) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.sum(value.cast("decimal(28,12)")).cast("double")
