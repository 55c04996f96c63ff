"""Writers for keyword tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_columns(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for formats without nesting."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    return df.withColumns({n: F.to_json(n) for n in nested}) if nested else df


def write_keywords(df: DataFrame, path: str, csv_path: str | None = None, mode: str = "overwrite") -> None:
    """Write by extension: .csv, .parquet, otherwise JSON lines; optionally CSV as well."""
    lower = path.lower()
    if lower.endswith(".csv"):
        _csv(df, path, mode)
    elif lower.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    if csv_path:
        _csv(df, csv_path, mode)


def write_json_array(df: DataFrame, path: str, buffer: int = 1 << 16) -> None:
    """One file that holds all rows as one JSON array, in the order of the partitions.

    Tasks write their rows with commas between them; the file system then joins the parts, in
    a buffer of fixed size, so that no row is held anywhere. An empty table is ``[]``.
    """
    spark = df.sparkSession
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.select(F.concat(F.when(first, "").otherwise(","), row).alias("value")).write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    folder = hadoop.fs.Path(parts)
    files = folder.getFileSystem(conf)
    found = sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(folder))
    out = files.create(hadoop.fs.Path(path), True)
    try:
        out.write(b"[\n")
        begun = False
        for name in (n for n, size in found if n.startswith("part-") and size):
            if begun:
                out.write(b",")
            part = files.open(hadoop.fs.Path(folder, name))
            try:
                hadoop.io.IOUtils.copyBytes(part, out, buffer, False)
            finally:
                part.close()
            begun = True
        out.write(b"]\n")
    finally:
        out.close()
    files.delete(folder, True)


def _csv(df: DataFrame, path: str, mode: str) -> None:
    flat_columns(df).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def run_id(moment: Column | None = None) -> Column:
    """Run identifier of the form YYYYMMDDHHMMSS."""
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyyMMddHHmmss")


def write_run(df: DataFrame, base_path: str, run: str | None = None, mode: str = "append") -> None:
    """Write under ``run_id=<run>`` below the base path."""
    identifier = run_id() if run is None else F.lit(run)
    df.withColumn("run_id", identifier).write.mode(mode).partitionBy("run_id").parquet(base_path)
