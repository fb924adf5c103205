"""Queries over grids, runs, deltas, baselines, bands and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, series
from . import bindings as B
from .registry import query

HOURLY = "h AS (SELECT user_id % 20 AS asn, epoch(date_trunc('hour', ts))::BIGINT AS slot, count(*) AS n FROM events GROUP BY ALL)"
GRID = "g AS (SELECT asn, unnest(range(lo, hi + 1, 3600)) AS slot FROM (SELECT asn, min(slot) AS lo, max(slot) AS hi FROM h GROUP BY asn))"
FULL = "f AS (SELECT g.asn, g.slot, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'not_observed' WHEN n = 0 THEN 'observed_zero' ELSE 'observed_nonzero' END AS value_state FROM g LEFT JOIN h USING (asn, slot))"
STATE = "s AS (SELECT asn, slot, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 2 THEN 'low' ELSE 'high' END AS state FROM f)"


def hourly(spark, sf_dir):
    slot = F.unix_timestamp(F.date_trunc("hour", "ts"))
    return B.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("asn"), slot.alias("slot")).agg(F.count("*").alias("n"))


def filled(spark, sf_dir):
    h = hourly(spark, sf_dir)
    bounds = h.groupBy("asn").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    return series.on_grid(h, intervals.slot_grid(bounds, ["asn"], "lo", "hi", 3600), ["asn"], "slot", "n", zero_fill=True)


def stated(spark, sf_dir):
    return filled(spark, sf_dir).withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("n") < 2, "low").otherwise("high"))


def daily(spark, sf_dir):
    """Values of each network and day, as DOUBLE."""
    slot = F.unix_timestamp(F.date_trunc("day", "ts"))
    return B.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("asn"), slot.alias("slot")).agg(F.count("*").cast("double").alias("v"))


DAILY = "d AS (SELECT user_id % 20 AS asn, epoch(date_trunc('day', ts))::BIGINT AS slot, count(*)::DOUBLE AS v FROM events GROUP BY ALL)"


@query("metric_grid", f"WITH {HOURLY}, {GRID}, {FULL} SELECT asn, slot, n, value_state FROM f")
def metric_grid(spark, sf_dir):
    return filled(spark, sf_dir)


@query("slot_deltas", f"WITH {HOURLY}, {GRID}, {FULL} SELECT asn, slot, n, n - lag(n) OVER (PARTITION BY asn ORDER BY slot) AS delta FROM f")
def slot_deltas(spark, sf_dir):
    return series.deltas(filled(spark, sf_dir).drop("value_state"), ["asn"], "slot", "n")


@query(
    "missing_slot_ranges",
    f"WITH {HOURLY}, n AS (SELECT asn, slot, lead(slot) OVER (PARTITION BY asn ORDER BY slot) AS nx FROM h) SELECT asn, slot + 3600 AS first_missing, nx - 3600 AS last_missing, (nx - slot) // 3600 - 1 AS n_missing FROM n WHERE nx - slot > 3600",
)
def missing_slot_ranges(spark, sf_dir):
    return intervals.missing_ranges(hourly(spark, sf_dir), ["asn"], "slot", 3600)


RUNS = f"""{HOURLY}, {GRID}, {FULL}, {STATE},
c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY asn ORDER BY slot) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS ch FROM s),
r AS (SELECT *, sum(ch) OVER (PARTITION BY asn ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM c)"""


@query("state_runs", f"WITH {RUNS} SELECT asn, CAST(run AS BIGINT) AS run, state, min(slot) AS first, max(slot) AS last, count(*) AS n FROM r GROUP BY asn, run, state")
def state_runs(spark, sf_dir):
    return intervals.runs_of(stated(spark, sf_dir), ["asn"], "slot", "state")


@query("longest_runs", f"WITH {RUNS}, x AS (SELECT asn, run, state, count(*) AS n FROM r GROUP BY asn, run, state) SELECT asn, state, max(n) AS longest, CAST(sum(n) AS BIGINT) AS total FROM x GROUP BY asn, state")
def longest_runs(spark, sf_dir):
    return intervals.longest_runs(stated(spark, sf_dir), ["asn"], "slot", "state")


@query("run_histogram", f"WITH {RUNS}, x AS (SELECT asn, run, state, count(*) AS n FROM r GROUP BY asn, run, state) SELECT state, n AS slots, count(*) AS n_runs FROM x GROUP BY state, n")
def run_histogram(spark, sf_dir):
    return intervals.runs_of(stated(spark, sf_dir), ["asn"], "slot", "state").groupBy("state", F.col("n").alias("slots")).agg(F.count("*").alias("n_runs"))


@query(
    "state_transitions",
    f"WITH {HOURLY}, {GRID}, {FULL}, {STATE}, l AS (SELECT *, lag(slot) OVER w AS from_at, lag(state) OVER w AS from_state FROM s WINDOW w AS (PARTITION BY asn ORDER BY slot)) SELECT asn, from_at, slot AS at_slot, from_state, state AS to_state FROM l WHERE from_at IS NOT NULL AND from_state <> state",
)
def state_transitions(spark, sf_dir):
    return intervals.transitions(stated(spark, sf_dir), ["asn"], "slot", "state").withColumnRenamed("at", "at_slot")


@query("state_population", f"WITH {HOURLY}, {GRID}, {FULL}, {STATE} SELECT slot, count(*) FILTER (state = 'empty') AS n_empty, count(*) FILTER (state = 'low') AS n_low, count(*) FILTER (state = 'high') AS n_high FROM s GROUP BY slot")
def state_population(spark, sf_dir):
    return stated(spark, sf_dir).groupBy("slot").agg(*[F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("empty", "low", "high")])


@query(
    "onset_slots",
    f"""WITH {HOURLY}, {GRID}, {FULL}, w AS (SELECT asn, slot, min((n = 0)::INT) OVER v AS held, count(*) OVER v AS c FROM f WINDOW v AS (PARTITION BY asn ORDER BY slot ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT asn, slot FROM w WHERE held = 1 AND c = 2""",
)
def onset_slots(spark, sf_dir):
    rows = filled(spark, sf_dir)
    return rows.withColumn("onset", series.consecutive(F.col("n") == 0, ["asn"], "slot", 2, 3600)).filter("onset").select("asn", "slot")


@query(
    "key_points",
    f"""WITH {DAILY}, x AS (SELECT *, v - lag(v) OVER (PARTITION BY asn ORDER BY slot) AS delta FROM d)
SELECT asn, (array_agg(v ORDER BY slot))[1] AS start_value, (array_agg(v ORDER BY slot DESC))[1] AS end_value, min(v) AS min_value, (array_agg(slot ORDER BY v, slot))[1] AS min_slot, max(v) AS max_value,
       (array_agg(slot ORDER BY v DESC, slot))[1] AS max_slot, min(CASE WHEN delta IS NULL THEN 0 ELSE least(delta, 0) END) AS largest_drop, (array_agg(slot ORDER BY least(coalesce(delta, 0), 0), slot))[1] AS drop_slot,
       max(greatest(coalesce(delta, 0), 0)) AS largest_rise, (array_agg(slot ORDER BY greatest(coalesce(delta, 0), 0) DESC, slot))[1] AS rise_slot
FROM x GROUP BY asn""",
)
def key_points(spark, sf_dir):
    return series.key_points(daily(spark, sf_dir), ["asn"], "slot", "v")


@query(
    "window_ledger",
    f"""WITH {DAILY}, x AS (SELECT *, first_value(v) OVER (PARTITION BY asn ORDER BY slot) AS reference FROM d),
y AS (SELECT asn, any_value(reference) AS reference, min(v) AS lowest, (array_agg(v ORDER BY slot DESC))[1] AS final, sum(greatest(reference - v, 0)) AS gap_integral,
      count(*) FILTER (v < 0.95 * reference) AS below_95, count(*) FILTER (v < 0.9 * reference) AS below_90, count(*) FILTER (v < 0.8 * reference) AS below_80 FROM x GROUP BY asn)
SELECT *, reference - lowest AS loss, final - lowest AS rebound, reference - final AS residual, CASE WHEN reference > lowest THEN (final - lowest) / (reference - lowest) END AS rebound_ratio FROM y""",
)
def window_ledger(spark, sf_dir):
    return series.window_ledger(daily(spark, sf_dir), ["asn"], "slot", "v")


@query(
    "slot_states",
    f"""WITH {DAILY}, m AS (SELECT asn, slot, v / max(v) OVER (PARTITION BY asn) AS ratio FROM d), x AS (SELECT *, abs(ratio - lag(ratio) OVER (PARTITION BY asn ORDER BY slot)) AS step FROM m)
SELECT asn, slot, ratio, CASE WHEN step >= 0.08 THEN 'abrupt' WHEN step >= 0.02 THEN 'directional' WHEN ratio <= 0.8 THEN 'low_plateau' ELSE 'stable' END AS slot_state FROM x""",
)
def slot_states(spark, sf_dir):
    return series.slot_states(ratios(spark, sf_dir), ["asn"], "slot", "ratio")


def ratios(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.join(d.groupBy("asn").agg(F.max("v").alias("most")), "asn").select("asn", "slot", (F.col("v") / F.col("most")).alias("ratio"))


@query(
    "curve_shape",
    f"""WITH {DAILY}, m AS (SELECT asn, slot, v / max(v) OVER (PARTITION BY asn) AS ratio FROM d), x AS (SELECT asn, slot, ratio - lag(ratio) OVER (PARTITION BY asn ORDER BY slot) AS delta FROM m),
y AS (SELECT asn, slot, CASE WHEN delta <= -0.02 THEN 'DEGRADING' WHEN delta >= 0.02 THEN 'RECOVERING' ELSE 'STABLE' END AS dir FROM x WHERE delta IS NOT NULL),
z AS (SELECT *, lag(dir) OVER (PARTITION BY asn ORDER BY slot) AS prior FROM y), s AS (SELECT asn, string_agg(dir, '→' ORDER BY slot) AS shape, count(*) AS n FROM z WHERE prior IS DISTINCT FROM dir GROUP BY asn)
SELECT asn, coalesce(shape, 'STABLE') AS shape, coalesce(n, 1) AS n_phases FROM (SELECT DISTINCT asn FROM d) LEFT JOIN s USING (asn)""",
)
def curve_shape(spark, sf_dir):
    return series.curve_shape(ratios(spark, sf_dir), ["asn"], "slot", "ratio")


@query(
    "median_band",
    f"""WITH {DAILY}, m AS (SELECT asn, quantile_cont(v, 0.5) AS median, count(v) AS n FROM d GROUP BY asn), a AS (SELECT asn, any_value(median) AS median, any_value(n) AS n, quantile_cont(abs(v - median), 0.5) AS mad FROM d JOIN m USING (asn) GROUP BY asn)
SELECT *, greatest(3 * mad, abs(median) * 0.001) AS half_width FROM a""",
)
def median_band(spark, sf_dir):
    return series.median_band(daily(spark, sf_dir), ["asn"], "v")


@query(
    "stable_baseline",
    f"""WITH {HOURLY}, b AS (SELECT *, min(slot) OVER (PARTITION BY asn) AS lo FROM h), w AS (SELECT asn, n::DOUBLE AS v, hrs FROM b, (VALUES (24), (72), (168), (336)) t(hrs) WHERE slot < lo + hrs * 3600),
m AS (SELECT asn, hrs, quantile_cont(v, 0.5) AS median FROM w GROUP BY ALL), a AS (SELECT asn, hrs, any_value(median) AS median, quantile_cont(abs(v - median), 0.5) AS mad FROM w JOIN m USING (asn, hrs) GROUP BY ALL),
k AS (SELECT asn, min(hrs) FILTER (median > 0 AND mad <= 0.3 * median) AS hours FROM a GROUP BY asn)
SELECT k.asn, hours, median, mad, CASE WHEN hours IS NULL THEN 'unstable' END AS reason FROM k LEFT JOIN a ON a.asn = k.asn AND a.hrs = hours""",
)
def stable_baseline(spark, sf_dir):
    h = hourly(spark, sf_dir)
    rows = h.join(h.groupBy("asn").agg(F.min("slot").alias("lo")), "asn")
    return series.stable_baseline(rows, ["asn"], "slot", "n", "lo", (24, 72, 168, 336), 0.3)


BASIS = "CASE WHEN len(kept) > 5 THEN list_transform(kept, lambda x: x.v) WHEN r.i < 7 THEN list_append(list_transform(kept, lambda x: x.v), r.v) ELSE []::DOUBLE[] END"


@query(
    "outlier_band",
    f"""WITH RECURSIVE {HOURLY}, r AS (SELECT asn, slot, n::DOUBLE AS v, row_number() OVER (PARTITION BY asn ORDER BY slot) AS i FROM h),
s AS (
  SELECT DISTINCT asn, 0::BIGINT AS i, NULL::BIGINT AS slot, NULL::DOUBLE AS n, []::STRUCT(t BIGINT, v DOUBLE)[] AS kept, NULL::BIGINT AS low, NULL::BIGINT AS high, 0::BIGINT AS size, false AS outlier FROM r
  UNION ALL
  SELECT asn, i, slot, v, list_filter(CASE WHEN out THEN kept ELSE list_append(kept, {{'t': slot, 'v': v}}) END, lambda x: x.t >= slot - 259200), low, high, size, out FROM (SELECT *, coalesce(v NOT BETWEEN low AND high, false) AS out FROM (
    SELECT asn, i, slot, v, kept, CASE WHEN moved THEN trunc((list_avg(basis) - 3 * list_stddev_pop(basis)) * 0.8)::BIGINT ELSE low END AS low, CASE WHEN moved THEN trunc((list_avg(basis) + 3 * list_stddev_pop(basis)) * 1.2)::BIGINT ELSE high END AS high, CASE WHEN moved THEN len(basis) ELSE size END AS size
    FROM (SELECT *, len(basis) > 0 AND len(basis) >= size AS moved FROM (SELECT r.asn, r.i, r.slot, r.v, kept, low, high, size, {BASIS} AS basis FROM s JOIN r ON r.asn = s.asn AND r.i = s.i + 1)))))
SELECT asn, slot, n, low, high, outlier FROM s WHERE i > 0""",
)
def outlier_band(spark, sf_dir):
    return series.outlier_band(hourly(spark, sf_dir).withColumn("n", F.col("n").cast("double")), ["asn"], "slot", "n")


@query("outage_episodes")
def outage_episodes(spark, sf_dir):
    rows = filled(spark, sf_dir)
    ratio = rows.join(rows.groupBy("asn").agg(F.max("n").alias("most")), "asn").select("asn", "slot", (F.col("n") / F.col("most")).alias("ratio"))
    return series.episodes(ratio, ["asn"], "slot", "ratio", step=3600, low=0.2, band=0.7, onset=2, recovery=2)


@query(
    "peer_percentile",
    f"WITH {DAILY}, t AS (SELECT asn, sum(v) AS total FROM d GROUP BY asn) SELECT asn, total, cume_dist() OVER (ORDER BY total) AS percentile FROM t",
)
def peer_percentile(spark, sf_dir):
    totals = daily(spark, sf_dir).groupBy("asn").agg(F.sum("v").alias("total"))
    return series.percentile_of(totals, "total", "percentile")


@query(
    "aligned_series",
    f"""WITH {DAILY}, j AS (SELECT a.asn, b.asn AS other, a.slot, a.v AS v4, b.v AS v6, a.v - b.v AS gap FROM d a JOIN d b ON a.slot = b.slot AND a.asn < b.asn)
SELECT asn, other, max(abs(gap)) AS largest_gap, (array_agg(slot ORDER BY abs(gap) DESC, slot))[1] AS gap_slot, (array_agg(slot ORDER BY v4, slot))[1] - (array_agg(slot ORDER BY v6, slot))[1] AS lag_of_minimum, count(*) AS n_slots FROM j GROUP BY asn, other""",
)
def aligned_series(spark, sf_dir):
    """Every pair of the networks' daily series, met by slot."""
    d = daily(spark, sf_dir)
    both = d.select("slot", "asn", F.col("v").alias("v4")).join(d.select("slot", F.col("asn").alias("other"), F.col("v").alias("v6")), "slot").filter("asn < other")
    gap = F.abs(F.col("v4") - F.col("v6"))
    low = lambda c: F.min_by("slot", F.struct(c, "slot"))
    return both.groupBy("asn", "other").agg(F.max(gap).alias("largest_gap"), F.max_by("slot", F.struct(gap, -F.col("slot"))).alias("gap_slot"), (low("v4") - low("v6")).alias("lag_of_minimum"), F.count("*").alias("n_slots"))
