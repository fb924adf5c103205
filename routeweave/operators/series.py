"""Time series on a fixed grid: filling, deltas, milestones, windows, baselines, bands and episodes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_grid(values: DataFrame, grid: DataFrame, keys: Sequence[str], slot: str, value: str, zero_fill: bool = False) -> DataFrame:
    """Every slot of the grid with the value, and its state: observed_zero, observed_nonzero or not_observed. Only sparse counts are filled with zero."""
    joined = grid.join(values.select(*keys, slot, value), [*keys, slot], "left")
    state = F.when(F.col(value).isNull(), "not_observed").when(F.col(value) == 0, "observed_zero").otherwise("observed_nonzero")
    filled = F.coalesce(F.col(value), F.lit(0)) if zero_fill else F.col(value)
    return joined.select(*keys, slot, filled.alias(value), state.alias("value_state"))


def deltas(df: DataFrame, keys: Sequence[str], slot: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(slot)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def consecutive(flag: Column, keys: Sequence[str], slot: str, n: int, step: int) -> Column:
    """True at the first of ``n`` contiguous slots that all hold the flag."""
    ahead = Window.partitionBy(*keys).orderBy(slot).rowsBetween(0, n - 1)
    held = F.min(F.when(flag, 1).otherwise(0)).over(ahead) == 1
    return held & (F.count("*").over(ahead) == n) & (F.max(slot).over(ahead) - F.col(slot) == (n - 1) * step)


def key_points(df: DataFrame, keys: Sequence[str], slot: str, value: str) -> DataFrame:
    """First, last, minimum, largest drop and largest rise of each series; ties keep the earliest."""
    rows = deltas(df, keys, slot, value).filter(F.col(value).isNotNull())
    earliest = -F.col(slot)
    drop, rise = F.least(F.col("delta"), F.lit(0)), F.greatest(F.col("delta"), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.min_by(value, slot).alias("start_value"), F.max_by(value, slot).alias("end_value"), F.min(value).alias("min_value"), F.min_by(slot, F.struct(value, slot)).alias("min_slot"),
        F.max(value).alias("max_value"), F.max_by(slot, F.struct(F.col(value), earliest)).alias("max_slot"),
        F.min(drop).alias("largest_drop"), F.min_by(slot, F.struct(drop, F.col(slot))).alias("drop_slot"), F.max(rise).alias("largest_rise"), F.max_by(slot, F.struct(rise, earliest)).alias("rise_slot"),
    )


def window_ledger(df: DataFrame, keys: Sequence[str], slot: str, value: str, thresholds: Sequence[float] = (0.95, 0.9, 0.8)) -> DataFrame:
    """Loss, rebound and residual against the first value of a series, the gap below it summed, and slots below shares of it."""
    w = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.filter(F.col(value).isNotNull()).withColumn("reference", F.first(value).over(w))
    below = [F.count_if(F.col(value) < t * F.col("reference")).alias(f"below_{int(t * 100)}") for t in thresholds]
    out = rows.groupBy(*keys).agg(F.first("reference").alias("reference"), F.min(value).alias("lowest"), F.max_by(value, slot).alias("final"), F.sum(F.greatest(F.col("reference") - F.col(value), F.lit(0))).alias("gap_integral"), *below)
    loss, residual = F.col("reference") - F.col("lowest"), F.col("reference") - F.col("final")
    return out.withColumns({"loss": loss, "rebound": loss - residual, "residual": residual}).withColumn("rebound_ratio", F.when(F.col("loss") > 0, F.col("rebound") / F.col("loss")))


def slot_states(df: DataFrame, keys: Sequence[str], slot: str, ratio: str) -> DataFrame:
    """abrupt at a step of 8 points, directional at 2, low_plateau at or below 0.8, else stable."""
    step = F.abs(F.col(ratio) - F.lag(ratio).over(Window.partitionBy(*keys).orderBy(slot)))
    state = F.when(F.col(ratio).isNull(), None).when(step >= 0.08, "abrupt").when(step >= 0.02, "directional").when(F.col(ratio) <= 0.8, "low_plateau").otherwise("stable")
    return df.withColumn("slot_state", state)


def curve_shape(df: DataFrame, keys: Sequence[str], slot: str, ratio: str, threshold: float = 0.02) -> DataFrame:
    """Directions of a ratio series as text, runs of one direction written once: RECOVERING and DEGRADING from a change of
    ``threshold``, else STABLE; a series of one slot is STABLE."""
    rows = deltas(df, keys, slot, ratio).withColumn("direction", F.when(F.col("delta") <= -threshold, "DEGRADING").when(F.col("delta") >= threshold, "RECOVERING").when(F.col("delta").isNotNull(), "STABLE"))
    w = Window.partitionBy(*keys).orderBy(slot)
    changes = rows.withColumn("prior", F.lag("direction").over(w)).withColumn("fresh", F.col("direction").isNotNull() & ~F.col("prior").eqNullSafe(F.col("direction")))
    listed = changes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("fresh"), F.struct(slot, "direction")))).alias("x"))
    shape = F.array_join(F.transform("x", lambda s: s["direction"]), "→")
    return listed.select(*keys, F.when(F.size("x") > 0, shape).otherwise("STABLE").alias("shape"), F.greatest(F.size("x"), F.lit(1)).cast("bigint").alias("n_phases"))


def percentile_of(df: DataFrame, value: str, name: str, buckets: int = 4096) -> DataFrame:
    """The share of rows at or below each row's value. Values are ranked inside equal-width buckets, and the buckets, at most
    ``buckets`` + 1 rows, among each other."""
    seen = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).first()
    width = ((seen["high"] or 0) - (seen["low"] or 0)) / buckets or 1
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")).withColumn("__bucket", F.floor((F.col(value) - seen["low"]) / width) if seen["n"] else F.lit(0))
    sums = counts.groupBy("__bucket").agg(F.sum("__n").alias("__size"))
    before = sums.select("__bucket", F.coalesce(F.sum("__size").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = counts.withColumn("__own", F.sum("__n").over(Window.partitionBy("__bucket").orderBy(value))).join(before, "__bucket")
    return df.join(ranked.select(value, ((F.col("__own") + F.col("__before")) / max(seen["n"], 1)).alias(name)), value, "left")


def median_band(df: DataFrame, keys: Sequence[str], value: str, least_half_width: float = 0.001) -> DataFrame:
    """Exact median, MAD and half width max(3 MAD, ``least_half_width`` of the median) of each series."""
    middle = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n"))
    off = df.join(middle, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.first("n").alias("n"), F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    return off.withColumn("half_width", F.greatest(3 * F.col("mad"), F.abs(F.col("median")) * least_half_width))


def stable_baseline(df: DataFrame, keys: Sequence[str], at: str, value: str, start: str, hours: Sequence[int] = (6, 12, 18, 24), stable: float = 0.001) -> DataFrame:
    """Median and MAD of the first window whose MAD is at most ``stable`` of the median; unresolved where none is. ``start`` is a column."""
    spread = df.select(*keys, F.col(value).cast("double").alias("v"), F.explode(F.array(*[F.when(F.col(at) < F.col(start) + h * 3600, F.lit(h)) for h in hours])).alias("hours")).filter("hours IS NOT NULL")
    band = median_band(spread, [*keys, "hours"], "v", stable)
    ok = F.when((F.col("median") > 0) & (F.col("mad") <= stable * F.col("median")), F.col("hours"))
    best = band.groupBy(*keys).agg(F.min(ok).alias("hours"), F.min_by(F.struct("median", "mad", "n"), F.coalesce(ok, F.lit(1 << 20))).alias("x"))
    return best.select(*keys, "hours", F.when(F.col("hours").isNotNull(), F.col("x.median")).alias("median"), F.when(F.col("hours").isNotNull(), F.col("x.mad")).alias("mad"), F.when(F.col("hours").isNull(), "unstable").alias("reason"))


def outlier_records(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], days: int = 3, least: int = 5, first: int = 7) -> DataFrame:
    """Records of several counts that are out of the ordinary. Each count has a band: mean and three standard deviations of the counts of the earlier normal records
    of ``days`` days, widened by 1.2 and 0.8 and cut to integers. It moves with more than ``least`` such records, or, with the present one, before the
    ``first``-th; and only when there are not fewer than before. One count outside its band makes the whole record an outlier, and no count of it is normal then.

    Adds ``low_<value>`` and ``high_<value>`` for each count, and ``outlier``. Whether a record counts depends on the verdicts before it, so each key is one ordered pass
    (grouped map) over its series, which must fit in a task; the window of ``days`` days is summed anew for each record. A NULL count is in no band and outside none.
    """

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        times, counts = pdf[at].to_numpy(), pdf[list(values)].to_numpy(np.float64, na_value=np.nan)
        normal, begin = np.zeros(len(pdf), bool), 0
        held = [(None, None, 0)] * len(values)
        lows, highs, outliers = [], [], []
        for k in range(len(pdf)):
            while begin < k and times[begin] < times[k - 1] - days * 86400:
                begin += 1
            earlier = counts[begin:k][normal[begin:k]]
            out = False
            for j in range(len(values)):
                basis = earlier[:, j][~np.isnan(earlier[:, j])]
                if len(basis) <= least:
                    basis = np.append(basis, counts[k, j]) if k + 1 < first and not np.isnan(counts[k, j]) else basis[:0]
                if len(basis) and len(basis) >= held[j][2]:
                    mean, std = basis.mean(), basis.std()
                    held[j] = int((mean - 3 * std) * 0.8), int((mean + 3 * std) * 1.2), len(basis)
                low, high, _ = held[j]
                out |= high is not None and not np.isnan(counts[k, j]) and not low <= counts[k, j] <= high
            normal[k] = not out
            lows.append([h[0] for h in held])
            highs.append([h[1] for h in held])
            outliers.append(out)
        found = {f"{side}_{v}": pd.array([x[j] for x in bounds], "Int64") for j, v in enumerate(values) for side, bounds in (("low", lows), ("high", highs))}
        return pdf.assign(**found, outlier=outliers)

    types = dict(df.dtypes)
    bounds = [f"{side}_{v} bigint" for v in values for side in ("low", "high")]
    schema = ", ".join([*(f"{c} {types[c]}" for c in (*keys, at, *values)), *bounds, "outlier boolean"])
    return df.select(*keys, at, *values).groupBy(*keys).applyInPandas(judge, schema)


def outlier_band(df: DataFrame, keys: Sequence[str], at: str, value: str, days: int = 3, least: int = 5, first: int = 7) -> DataFrame:
    """``outlier_records`` of one count, its band being ``low`` and ``high``."""
    return outlier_records(df, keys, at, [value], days, least, first).withColumnsRenamed({f"low_{value}": "low", f"high_{value}": "high"})


def episodes(df: DataFrame, keys: Sequence[str], slot: str, visible: str, damaged: str | None = None, step: int = 300, low: float = 0.99, above: float = 0.03, band: float = 0.001, onset: int = 2, recovery: int = 6) -> DataFrame:
    """Episodes of a series of visible shares of a baseline, and shares of damaged ASes.

    A slot is anomalous if the visible share is below ``low`` or the damaged one over ``above``, unknown if neither is and one
    is missing. ``onset`` anomalous slots in a row open an episode at the first of them. ``recovery`` slots in a row at ``low``
    or more are a partial recovery (at the end of the last), ``recovery`` slots within ``band`` of the baseline and not anomalous
    a full one, which closes the episode at the first of them. A missing share starts both counts anew. A gap in the slots ends an
    episode as unknown; one still open at the end has a lower bound for its duration. Each key is one ordered pass (grouped map).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(slot, kind="stable")
        head, out, active, pending, before = {k: pdf[k].iloc[0] for k in keys}, [], None, [], None

        def close(end: int | None, state: str, duration: str) -> None:
            out.append({**head, **{c: active[c] for c in ("start_slot", "trough", "trough_slot", "peak", "partial_at")}, "end_slot": end, "recovery_state": state, "duration_state": duration})

        damages = pdf[damaged] if damaged else [0.0] * len(pdf)
        for t, v, d in zip(pdf[slot], pdf[visible], damages):
            gap, before = before is not None and t != before + step, t
            if gap:
                pending = []
                if active:
                    close(None, "unknown", "unknown")
                active = None
                continue
            known = not (pd.isna(v) or pd.isna(d))
            bad = (not pd.isna(v) and v < low) or (not pd.isna(d) and d > above)
            if active is None:
                pending = [*pending, (t, v, d)] if bad else []
                if len(pending) < onset:
                    continue
                active = {"start_slot": pending[0][0], "trough": None, "trough_slot": None, "peak": None, "partial_at": None, "partial": 0, "full": 0, "last": None}
                seen, pending = pending, []
            else:
                seen = [(t, v, d)]
            for u, x, y in seen:
                if not pd.isna(x) and (active["trough"] is None or x < active["trough"]):
                    active["trough"], active["trough_slot"] = x, u
                if not pd.isna(y) and (active["peak"] is None or y > active["peak"]):
                    active["peak"] = y
                active["last"] = x
            if len(seen) > 1:
                continue
            active["partial"] = active["partial"] + 1 if not pd.isna(v) and v >= low else 0
            active["full"] = active["full"] + 1 if known and not bad and abs(v - 1) <= band else 0
            if active["partial"] >= recovery and active["partial_at"] is None:
                active["partial_at"] = t + step
            if active["full"] >= recovery:
                close(t - (recovery - 1) * step, "fully_recovered", "exact")
                active = None
        if active:
            last = active["last"]
            risen = not pd.isna(last) and active["trough"] is not None and last > active["trough"]
            close(None, "partially_recovered" if active["partial"] >= recovery else "recovering" if risen else "ongoing", "lower_bound")
        columns = [*keys, "start_slot", "end_slot", "trough", "trough_slot", "peak", "partial_at", "recovery_state", "duration_state"]
        found = pd.DataFrame(out, columns=columns)
        return found.astype({c: "Int64" for c in ("start_slot", "end_slot", "trough_slot", "partial_at")})

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "start_slot bigint, end_slot bigint, trough double, trough_slot bigint, peak double, partial_at bigint, recovery_state string, duration_state string"])
    return df.select(*keys, slot, visible, *([damaged] if damaged else [])).groupBy(*keys).applyInPandas(one, schema)
