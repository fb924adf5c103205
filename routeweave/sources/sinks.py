"""Parquet sinks with keys: first write wins, last version wins, events closed, months replaced.

A small keyed table is a folder of versions. A write reads the last whole version, writes the next one beside it and only then is
that one the table's, so a failed job leaves the old one as it was; versions before the last two are deleted.

A large one is a folder of buckets by a hash of the key. A write reads and replaces only the buckets that its rows fall into, with Spark's dynamic
partition overwrite; what a write becomes is first stored apart, so that no bucket is read while it is replaced. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import stored


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def whole_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end, in order."""
    fs, place = _folder(spark, path)
    if not fs.exists(place):
        return []
    names = [x.getPath() for x in fs.listStatus(place) if x.getPath().getName().startswith("v=")]
    return sorted(int(x.getName()[2:]) for x in names if fs.exists(_folder(spark, f"{x}/_SUCCESS")[1]))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version; None if there is none."""
    found = whole_versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as the next version and read it back."""
    spark = df.sparkSession
    found = whole_versions(spark, path)
    number = found[-1] + 1 if found else 0
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    for old in found[:-1]:
        fs, place = _folder(spark, f"{path}/v={old}")
        fs.delete(place, True)
    return spark.read.schema(df.schema).parquet(f"{path}/v={number}")


def append_absent(table: DataFrame | None, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` and those rows whose key it lacks; of several rows with one key the smallest is added."""
    rest = [c for c in rows.columns if c not in keys]
    fresh = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*").select(*rows.columns) if rest else rows.distinct()
    return fresh if table is None else table.unionByName(fresh.join(table.select(*keys), list(keys), "left_anti"))


def upsert(table: DataFrame | None, rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of each key with the highest version; of several with that version the greatest."""
    every = rows if table is None else table.unionByName(rows)
    rest = [c for c in every.columns if c not in (*keys, version)]
    return every.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("x")).select(*keys, "x.*").select(*every.columns)


def close_events(table: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Open events of ``table`` (end_s, duration_s) that ``ends`` (key, closed_s) names get their end; closed ones stay."""
    joined = table.join(ends.groupBy(key).agg(F.min("closed_s").alias("closed_s")), key, "left")
    end = F.coalesce("end_s", "closed_s")
    return joined.withColumns({"end_s": end, "duration_s": end - F.col("start_s")}).drop("closed_s").select(*table.columns)


def raise_peaks(table: DataFrame, peaks: DataFrame, key: str, peak: str) -> DataFrame:
    """The ``peak`` of open events of ``table`` (end_s) becomes that of ``peaks`` (key, peak) where it is higher; closed ones stay."""
    joined = table.join(peaks.groupBy(key).agg(F.max(peak).alias("__peak")), key, "left")
    return joined.withColumn(peak, F.when(F.col("end_s").isNull(), F.greatest(peak, "__peak")).otherwise(F.col(peak))).select(*table.columns)


def merge_buckets(path: str, rows: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64) -> int:
    """Merge ``rows`` into a bucketed table and return how many buckets were replaced. ``merge`` takes what those buckets hold (None in a new table) and the rows."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fs, place = _folder(spark, path)
    touched = sorted(r["b"] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
    if not touched:
        return 0
    held = read_buckets(spark, path) if fs.exists(place) else None
    if held is not None:
        held = held.filter(F.col("bucket").isin(touched)).drop("bucket").select(*rows.columns)
    merged = stored(merge(held, rows).withColumn("bucket", bucket))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A bucketed table, with ``bucket``."""
    return spark.read.parquet(path)


def replace_part(path: str, rows: DataFrame, part: Sequence[str]) -> None:
    """Replace those parts of a table that ``rows`` has, such as one country's edges; all others stay as they are."""
    rows.repartition(*part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def append_absent_to(path: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return write_table(append_absent(read_table(rows.sparkSession, path), rows, keys), path)


def upsert_to(path: str, rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return write_table(upsert(read_table(rows.sparkSession, path), rows, keys, version), path)


def close_events_in(path: str, ends: DataFrame, key: str) -> DataFrame:
    table = read_table(ends.sparkSession, path)
    if table is None:
        raise FileNotFoundError(path)
    return write_table(close_events(table, ends, key), path)


def utc_month(seconds: Column) -> Column:
    """``yyyyMM`` of UTC seconds, whatever the session's time zone: days are counted from 1970-01-01, which no zone shifts."""
    day = F.date_add(F.lit(date(1970, 1, 1)), F.floor(seconds / 86400).cast("int"))
    return F.format_string("%04d%02d", F.year(day), F.month(day))


def write_monthly(df: DataFrame, path: str, at: str, extra: Sequence[str] = (), files: int = 8) -> None:
    """Parquet by month in UTC (and other columns, such as the country), a month in at most ``files`` files written by as many tasks; only
    the months, or the months of the countries, that are written are replaced."""
    months = df.withColumn("ym", utc_month(F.col(at)))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    writer = months.repartition(*extra, "ym", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*extra, "ym").parquet(path)


def read_months(spark: SparkSession, path: str, at: str, first_s: int, last_s: int) -> DataFrame:
    """Rows of a monthly table from ``first_s`` to ``last_s``, both included: months outside are not listed for reading."""
    month = lambda s: datetime.fromtimestamp(s, timezone.utc).strftime("%Y%m")
    table = spark.read.schema(spark.read.parquet(path).drop("ym").schema.add("ym", "string")).parquet(path)
    return table.filter(F.col("ym").between(month(first_s), month(last_s)) & F.col(at).between(first_s, last_s))
