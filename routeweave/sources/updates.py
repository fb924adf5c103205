"""Pipe-delimited update and RIB text as DataFrames, in batch and as a stream.

A line is ``type|epoch|flag|peer_ip|peer_asn|prefix|as_path``. Each record carries its file and its place in it, so that equal
times have an order; lines that do not parse are kept apart with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("record_type", "epoch_s", "flag", "peer_ip", "peer_asn", "prefix", "as_path")
DEFAULT_ROUTES = ("0.0.0.0/0", "::/0")


def parse(lines: DataFrame) -> DataFrame:
    """Columns of ``lines`` (value, and any others) with the fields and ``reason``: why a line is no usable route, or NULL."""
    parts = F.split("value", r"\|", -1)
    field = {name: F.nullif(F.get(parts, k), F.lit("")) for k, name in enumerate(FIELDS)}
    out = lines.withColumns(field | {"n_fields": F.size(parts)}).withColumn("epoch_s", F.col("epoch_s").try_cast("bigint"))
    reason = (
        F.when(F.col("n_fields") < 6, "too_few_fields")
        .when(F.col("flag") == "STATE", "session_state")
        .when(~F.col("flag").isin("A", "W", "B"), "unknown_flag")
        .when(F.col("epoch_s").isNull(), "bad_time")
        .when(F.col("prefix").isNull(), "no_prefix")
        .when(F.col("prefix").isin(*DEFAULT_ROUTES), "default_route")
        .when(F.contains(F.coalesce("as_path", F.lit("")), F.lit("{")), "as_set")
        .when((F.col("flag") != "W") & F.col("as_path").isNull(), "no_path")
    )
    return out.withColumn("reason", reason).withColumn("action", F.when(F.col("flag") == "W", "withdraw").otherwise("announce"))


def _ordered(df: DataFrame) -> DataFrame:
    return df.select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("line"))


def read_updates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(routes, rejected) of update files; ``line`` grows within a file."""
    parsed = parse(_ordered(spark.read.text(path)))
    names = ["file", "line", "epoch_s", "action", "peer_ip", "peer_asn", "prefix", "as_path"]
    return parsed.filter("reason IS NULL").select(*names), parsed.filter("reason IS NOT NULL").select("file", "line", "value", "reason")


def read_rib(spark: SparkSession, path: str, origins: DataFrame | None = None) -> DataFrame:
    """Current route of each (prefix, peer_asn) of RIB files, the later line winning; ``origins`` (origin) keeps only their routes."""
    parsed = parse(_ordered(spark.read.text(path))).filter("reason IS NULL AND n_fields >= 7")
    last = parsed.groupBy("prefix", "peer_asn").agg(F.max_by(F.struct("epoch_s", "as_path", "peer_ip"), F.struct("file", "line")).alias("x"))
    routes = last.select("prefix", "peer_asn", "x.*").withColumn("origin", F.element_at(F.split("as_path", " "), -1))
    return routes if origins is None else routes.join(origins.select("origin").distinct(), "origin", "left_semi")


def with_prior_path(updates: DataFrame, rib: DataFrame) -> DataFrame:
    """Updates with the path their route had before (``prior_path``): NULL after a withdrawal, the RIB's for the first update."""
    seed = rib.select("prefix", "peer_asn", F.lit("").alias("file"), F.lit(-1).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("epoch_s"), F.lit("rib").alias("action"), "as_path")
    rows = updates.select(*seed.columns).union(seed)
    w = Window.partitionBy("prefix", "peer_asn").orderBy("epoch_s", "file", "line")
    return rows.withColumn("prior_path", F.lag(F.when(F.col("action") != "withdraw", F.col("as_path"))).over(w)).filter("action <> 'rib'")


def stream_updates(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder, oldest first, as parsed routes with an event time."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").text(path)
    parsed = parse(lines.select("value", F.col("_metadata.file_name").alias("file")))
    return parsed.filter("reason IS NULL").select("file", "epoch_s", F.timestamp_seconds("epoch_s").alias("ts"), "action", "peer_ip", "peer_asn", "prefix", "as_path")


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(session changes, rejected) of update files: ``STATE`` lines hold the old and the new state by number."""
    parsed = parse(_ordered(spark.read.text(path))).filter("reason = 'session_state'")
    rows = parsed.select("file", "line", "epoch_s", "peer_ip", "peer_asn", F.col("prefix").try_cast("int").alias("old_state"), F.col("as_path").try_cast("int").alias("new_state"), "value")
    valid = F.col("epoch_s").isNotNull() & F.col("old_state").between(1, 6) & F.col("new_state").between(1, 6)
    return rows.filter(valid).drop("value"), rows.filter(~F.coalesce(valid, F.lit(False))).select("file", "line", "value", F.lit("bad_session_state").alias("reason"))


def slot_of_file(name: Column) -> Column:
    """UTC seconds in a name like ``updates.20260227.0805.gz``."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}\.\d{4})", 1), F.lit("yyyyMMdd.HHmm")))


def archive_inventory(spark: SparkSession, path: str, step: int = 300) -> tuple[DataFrame, DataFrame]:
    """(files with their slot and size, slots between the first and the last that no file has)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length").withColumn("slot", slot_of_file(F.col("file")))
    bounds = files.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).filter("lo IS NOT NULL")
    grid = bounds.select(F.explode(F.sequence("lo", "hi", F.lit(step))).alias("slot"))
    return files, grid.join(files.select("slot").distinct(), "slot", "left_anti")
