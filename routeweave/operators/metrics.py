"""Metric series: a point with a state for every slot, what a series has observed, and checks that hold a published series against its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a point, and classes of a slot. A slot without a class has no source.
OBSERVED = ("observed_zero", "observed_nonzero")
STATES = (*OBSERVED, "not_applicable", "not_observed", "source_unavailable", "parse_failed", "processing_gap", "legacy_unknown")
AVAILABLE, PARSE_FAILED, PROCESSING_GAP, LEGACY = "available", "parse_failed", "processing_gap", "legacy_unknown"
#: Counts that are zero where a sparse table has no row.
SPARSE = ("announce", "withdraw", "update_total")
UPDATES = ("announce", "withdraw", "update_total", "withdraw_ratio")
#: A point that no rule explains: the source is there, the row is not, and the metric is not sparse.
UNEXPLAINED = "row_missing"


def _value(kind: str) -> Column:
    if kind == "announce":
        return F.col("announces").cast("double")
    if kind == "withdraw":
        return F.col("withdraws").cast("double")
    if kind == "update_total":
        return (F.col("announces") + F.col("withdraws")).cast("double")
    if kind == "withdraw_ratio":
        return F.try_divide(F.col("withdraws").cast("double"), (F.col("announces") + F.col("withdraws")).cast("double"))
    if kind == "concurrency":
        return F.when(F.size("samples") > 0, F.array_max("samples")).cast("double")
    if kind == "incidents":
        return F.size("incident_ids").cast("double")
    return F.col(kind).cast("double")


def metric_points(rows: DataFrame, slots: DataFrame, kind: str, sparse: bool = False) -> DataFrame:
    """(subject, slot, value, value_state, missing_reason, numerator, denominator, active): one point for every expected slot.

    ``slots``: (subject, slot, class) of all expected slots; ``rows``: (subject, slot) once each, with ``announces`` and ``withdraws``, a resource column named by ``kind``, ``incident_ids`` or ``samples`` (concurrent counts at
    sampled times). The class decides first: a slot that failed to parse, has no source (NULL), lies in a processing gap or is unknown by declaration has no value, whatever rows there are. Then a missing
    row is zero only for a sparse update count; a resource is ``not_observed``; no sample at all is ``legacy_unknown`` and never zero; a ratio over nothing is ``not_applicable``. ``active`` tells that the source had a row.
    """
    if sparse and kind not in SPARSE:
        raise ValueError(f"{kind} is not a sparse update count")
    joined = slots.join(rows.withColumn("__row", F.lit(True)), ["subject", "slot"], "left")
    here, kept = F.col("__row").isNotNull(), F.coalesce(F.col("class") == AVAILABLE, F.lit(False))
    value = F.coalesce(_value(kind), F.lit(0.0)) if sparse else _value(kind)
    value = F.when(kept & (here | F.lit(sparse)), value)
    resource = kind not in (*UPDATES, "concurrency", "incidents")
    missing = F.when(F.col("class").isNull(), "source_unavailable").when(F.col("class") != AVAILABLE, F.col("class"))
    if kind == "withdraw_ratio":
        missing = missing.when(here & value.isNull(), "not_applicable")
    if kind == "concurrency":
        missing = missing.when(here & value.isNull(), LEGACY)
    missing = missing.when(value.isNull(), F.lit("not_observed" if resource else UNEXPLAINED))
    state = F.coalesce(missing, F.when(value == 0, OBSERVED[0]).otherwise(OBSERVED[1]))
    reason = F.when(missing == "not_applicable", "denominator_zero").otherwise(missing)
    parts = (F.when(kept & here, F.col("withdraws")), F.when(kept & here, F.col("announces") + F.col("withdraws"))) if kind == "withdraw_ratio" else (F.lit(None), F.lit(None))
    return joined.select(
        "subject", "slot", value.alias("value"), state.alias("value_state"), reason.alias("missing_reason"), parts[0].cast("bigint").alias("numerator"), parts[1].cast("bigint").alias("denominator"), (kept & here).alias("active")
    )


def metric_coverage(points: DataFrame) -> DataFrame:
    """How much of each subject's series was expected, had a source, was observed and had rows of its own; ratios to ten digits, NULL over nothing."""
    sourced = ~F.col("value_state").isin("source_unavailable", PARSE_FAILED)
    sums = points.groupBy("subject").agg(
        F.count("*").alias("expected"), F.count_if(sourced).alias("source_observed"), F.count_if(F.col("value_state").isin(*OBSERVED)).alias("metric_observed"), F.count_if("active").alias("active"),
        F.count_if(F.col("value_state") == PROCESSING_GAP).alias("processing_gaps"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 10)
    return sums.withColumns({"source_ratio": ratio("source_observed", "expected"), "metric_ratio": ratio("metric_observed", "expected"), "density": ratio("active", "source_observed"), "source_gaps": F.col("expected") - F.col("source_observed")})


def metric_checks(points: DataFrame, expected: DataFrame, step: int, tolerance: float = 1e-9) -> DataFrame:
    """(subject, check, violations) of a published series against ``expected``, points of the same form that were made from the source again.

    ``slot_closure``: slots that are missing, double or off the grid; ``formula``: ratios that are not their parts, or parts without a ratio; ``missing_state``: values with a missing state, states without a value, unknown states,
    and zeros called nonzero; ``no_zero_fill``: zeros where the source has no value; ``source_points``: points that differ from the source, on either side. Both sides meet once, by subject and slot.
    """
    own = Window.partitionBy("subject").orderBy("slot")
    gap = F.col("slot") - F.lag("slot").over(own)
    observed = F.col("value_state").isin(*OBSERVED)
    ratio = F.col("denominator").isNotNull()
    wrong_formula = ratio & ~F.when(F.col("denominator") == 0, F.col("value").isNull() & (F.col("value_state") == "not_applicable")).otherwise(F.coalesce(F.abs(F.col("value") - F.col("numerator") / F.nullif("denominator", F.lit(0))) <= tolerance, F.lit(False)))
    known = F.col("value_state").isin(*STATES)
    zero = (F.col("value") == 0) == (F.col("value_state") == OBSERVED[0])
    wrong_state = ~F.coalesce(known, F.lit(False)) | (observed != F.col("value").isNotNull()) | (observed & ~zero) | (F.col("missing_reason").isNull() != observed)
    single = points.withColumns({"__gap": F.coalesce(gap != step, F.lit(False)), "__formula": wrong_formula, "__state": wrong_state})
    alone = single.groupBy("subject").agg(F.count_if("__gap").alias("slot_closure"), F.count_if("__formula").alias("formula"), F.count_if("__state").alias("missing_state"))
    side = lambda df, name: df.select("subject", "slot", F.struct("value", "value_state").alias(name))
    both = side(points, "told").join(side(expected, "true"), ["subject", "slot"], "full")
    same = F.col("told.value_state").eqNullSafe(F.col("true.value_state")) & (F.col("told.value").eqNullSafe(F.col("true.value")) | F.coalesce(F.abs(F.col("told.value") - F.col("true.value")) <= tolerance, F.lit(False)))
    filled = (F.col("told.value") == 0) & F.col("true.value").isNull()
    against = both.groupBy("subject").agg(F.count_if(filled).alias("no_zero_fill"), F.count_if(~same).alias("source_points"), F.count_if(F.col("told").isNull() | F.col("true").isNull()).alias("__unmet"))
    joined = against.join(alone, "subject", "left").na.fill(0).withColumn("slot_closure", F.col("slot_closure") + F.col("__unmet"))
    checks = ("slot_closure", "formula", "missing_state", "no_zero_fill", "source_points")
    return joined.select("subject", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in checks])).alias("x")).select("subject", "x.*")


def country_samples(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row that binds all measures of a slot: the full join of tables with the same keys, a measure that a slot lacks being NULL, and ``measures``: the names of those that are there."""
    out, names = None, []
    for part in parts:
        names += [c for c in part.columns if c not in keys]
        out = part if out is None else out.join(part, list(keys), "full")
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]))
    return out.withColumn("measures", present)
