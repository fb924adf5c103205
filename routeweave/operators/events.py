"""Event queries: search, windows of comparison, counts, rankings and set operations over event and fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(events: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, between: dict[str, tuple] | None = None, least_seconds: int | None = None, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Exact, LIKE (NULL counts as empty) and inclusive range filters, and a least duration that open events pass."""
    out = events
    for c, v in (equal or {}).items():
        out = out.filter(F.col(c) == v)
    for c, v in (like or {}).items():
        out = out.filter(F.coalesce(F.col(c), F.lit("")).like(v))
    for c, (low, high) in (between or {}).items():
        out = out.filter(F.col(c).between(low, high))
    if least_seconds is not None:
        out = out.filter(F.col(end).isNull() | (F.col(end) - F.col(start) >= least_seconds))
    return out


def overlapping(events: DataFrame, low: Column, high: Column, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Events that overlap [low, high]; an open event has no end."""
    return events.filter((F.col(start) <= high) & (F.col(end).isNull() | (F.col(end) >= low)))


def contained(events: DataFrame, low: Column, high: Column, start: str = "start_s", end: str = "end_s") -> DataFrame:
    return events.filter((F.col(start) >= low) & (F.col(end) <= high))


def counts_by(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"))


def compare_windows(df: DataFrame, keys: Sequence[str], at: str, value: str, split: Column, seconds: int) -> DataFrame:
    """One row for each key: sums of the ``seconds`` up to ``split`` and of as long before, samples, latest value, peak and its time."""
    now = (F.col(at) >= split - seconds) & (F.col(at) < split)
    before = (F.col(at) >= split - 2 * seconds) & (F.col(at) < split - seconds)
    v, t = F.col(value), F.col(at)
    return df.filter(now | before).groupBy(*keys).agg(
        F.sum(F.when(now, v)).alias("current_sum"), F.sum(F.when(before, v)).alias("previous_sum"), F.count_if(now).alias("samples"),
        F.max_by(F.when(now, v), F.when(now, t)).alias("latest"), F.max(F.when(now, v)).alias("peak"), F.max_by(t, F.when(now, F.struct(v, -t))).alias("peak_at"),
    )


def profile(compared: DataFrame) -> DataFrame:
    """Adds delta and percent change (NULL where the previous sum is zero or missing)."""
    change = F.when(F.col("previous_sum") != 0, (F.col("current_sum") - F.col("previous_sum")) / F.col("previous_sum") * 100)
    return compared.withColumns({"delta": F.col("current_sum") - F.col("previous_sum"), "change_percent": change})


def top_n(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, of each key if there are any, with their rank."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= n)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """One count column for each value and a total."""
    named = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(*keys).agg(*named, F.count("*").alias("total"))


def nested_series(entities: DataFrame, points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each entity with its sorted series of (at, value); [] where it has none."""
    listed = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, value))).alias("series"))
    joined = entities.join(listed, key, "left")
    return joined.withColumn("series", F.coalesce("series", F.array().cast(listed.schema["series"].dataType)))


def around_events(events: DataFrame, points: DataFrame, key: str, start: str, at: str, value: str, before: int, gap: int, after: int, bucket: int = 86_400) -> DataFrame:
    """Average and maximum of [start - before, start - gap) and the minimum of [start, start + after) for each event. The range
    join meets in buckets of ``bucket`` seconds, so a busy key is spread over its days."""
    spans = events.select("event_id", key, start, F.explode(F.sequence(F.floor((F.col(start) - before) / bucket), F.floor((F.col(start) + after) / bucket))).alias("bucket"))
    keyed = points.select(key, at, value, F.floor(F.col(at) / bucket).alias("bucket"))
    met = spans.join(keyed, [key, "bucket"]).filter((F.col(at) >= F.col(start) - before) & (F.col(at) < F.col(start) + after))
    early = F.when(F.col(at) < F.col(start) - gap, F.col(value))
    late = F.when(F.col(at) >= F.col(start), F.col(value))
    return met.groupBy("event_id").agg(F.avg(early).alias("baseline_avg"), F.max(early).alias("baseline_max"), F.min(late).alias("after_min"))


def nearest_before(anchors: DataFrame, rows: DataFrame, key: str, anchor: str, at: str, value: str) -> DataFrame:
    """As-of state: the last value of each key at or before each anchor; NULL where there is none."""
    marks = anchors.select(key, F.col(anchor).alias("t"), F.lit(None).cast(dict(rows.dtypes)[value]).alias("v"), F.lit(1).alias("is_anchor"))
    both = marks.union(rows.select(key, at, value, F.lit(0)))
    w = Window.partitionBy(key).orderBy("t", "is_anchor").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("is_anchor = 1")
    return found.select(key, F.col("t").alias(anchor), F.col("v").alias(value))


def set_compare(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each key of two sets with the side it is on: both, only_a or only_b."""
    one, two = a.select(*key).distinct().withColumn("a", F.lit(1)), b.select(*key).distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return one.join(two, list(key), "full").select(*key, side.alias("side"))


def first_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` of all rows with their rank: each task keeps its first ``n``, and only those are ranked."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
