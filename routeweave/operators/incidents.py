"""Incidents of a fixed population: episodes, their milestones, and times that are known exactly, from one side, or not at all."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPISODE = (
    "subject string, ordinal int, onset_at bigint, onset_precision string, peak_at bigint, peak_value double, trough_at bigint, trough_value double, partial_recovery_at bigint, "
    "full_recovery_at bigint, observation_end_at bigint, duration_state string, duration_seconds bigint, recovery_state string"
)


@dataclass(frozen=True)
class Rules:
    """Thresholds, and how many slots in a row confirm. ``band``: the normal range of both visible ratios, without which no recovery is full."""

    damaged: float = 0.03
    onset_slots: int = 2
    recovered: float = 0.99
    recovery_slots: int = 6
    asn_band: tuple[float, float] | None = None
    prefix_band: tuple[float, float] | None = None


def _confirmed(flags: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``flags`` hold ``n`` times in a row."""
    if len(flags) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.convolve(flags, np.ones(n, np.int64), "valid") == n)


def _from(places: np.ndarray, at: int) -> int | None:
    k = np.searchsorted(places, at)
    return int(places[k]) if k < len(places) else None


def _episodes(rows: pd.DataFrame, rules: Rules) -> list[tuple]:
    """The episodes of one subject's series: each jump goes from a confirmed onset to the end of a confirmed full recovery, and on from there."""
    rows = rows.sort_values("observed_at", kind="stable").reset_index(drop=True)
    at = rows["observed_at"].to_numpy(np.int64)
    affected, asns, prefixes = (rows[c].to_numpy(np.float64, na_value=np.nan) for c in ("affected_asn_ratio", "visible_origin_asn_ratio", "visible_prefix_vp_ratio"))
    known = (rows["continuity_state"] == "continuous").to_numpy()
    inside = [np.zeros(len(at), bool) if band is None else (x >= band[0]) & (x <= band[1]) for x, band in ((asns, rules.asn_band), (prefixes, rules.prefix_band))]
    anomaly = known & (affected > rules.damaged)
    onsets = _confirmed(anomaly, rules.onset_slots)
    partials = _confirmed(known & (asns >= rules.recovered) & (prefixes >= rules.recovered), rules.recovery_slots)
    fulls = _confirmed(known & inside[0] & inside[1], rules.recovery_slots)
    severity = np.maximum(affected, 1 - prefixes)
    out, start = [], _from(onsets, 0)
    while start is not None:
        full = _from(fulls, start)
        end = len(at) - 1 if full is None else full + rules.recovery_slots - 1
        partial = _from(partials, start)
        partial = None if partial is None or full is not None and partial > full else partial
        span = slice(start, end + 1)
        peak = start + int(np.nan_to_num(affected[span], nan=-1).argmax())
        trough = start + int(np.nan_to_num(prefixes[span], nan=2).argmin())
        censored = start == 0
        if full is not None:
            state, recovery, seconds = "exact", "fully_recovered", at[full] - at[start]
        else:
            state, seconds = "interval" if censored else "lower_bound", at[end] - at[start]
            if np.isnan(prefixes[span]).any() or np.isnan(asns[span]).any():
                recovery = "unknown"
            elif partial is not None:
                recovery = "partially_recovered"
            else:
                recovery = "recovering" if severity[end] < severity[trough] else "ongoing"
        seen = lambda x: None if x is None else int(at[x])
        value = lambda x: None if np.isnan(x) else float(x)
        out.append((
            len(out) + 1, seen(start), "left_censored_at_window_start" if censored else "five_minute_state", seen(peak), value(affected[peak]), seen(trough), value(prefixes[trough]),
            seen(partial), seen(full), seen(end), state, int(seconds), recovery,
        ))
        start = None if full is None else _from(onsets, end + 1)
    return out


def incident_episodes(observations: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row for each episode of each subject (``EPISODE``).

    ``observations``: (subject, observed_at, continuity_state, affected_asn_ratio, visible_origin_asn_ratio, visible_prefix_vp_ratio), a row for each slot. An episode begins with the first of ``onset_slots``
    damaged slots in a row and is over when both visible ratios have been normal for ``recovery_slots``; the first of these is its full recovery, and its length is then exact. An open episode's length is a lower bound, and an
    ``interval`` where the first observation is already damaged. A slot that follows a gap or lacks a ratio confirms nothing. Peak and trough are the first of equal ones; ratios of zero count.
    A subject's series, a few thousand slots, is one group; jumps go from episode to episode, not from row to row.
    """
    rules = rules or Rules()

    def derive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame([(key[0], *e) for e in _episodes(rows, rules)], columns=[c.split()[0] for c in EPISODE.split(", ")])
        return found.astype({c: "Int64" for c in ("partial_recovery_at", "full_recovery_at")})

    columns = ["subject", "observed_at", "continuity_state", "affected_asn_ratio", "visible_origin_asn_ratio", "visible_prefix_vp_ratio"]
    return observations.select(*columns).groupBy("subject").applyInPandas(derive, EPISODE)


def incidents(observations: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row for each subject: first onset, worst peak and trough over its episodes, the last one's recovery, and how its length is known: a ``lower_bound`` if any episode's is, else an ``interval`` if any
    is, else exact; all unknown without episodes."""
    last = F.max_by(F.struct("partial_recovery_at", "full_recovery_at", "recovery_state"), "ordinal")
    sums = episodes.groupBy("subject").agg(
        F.count("*").alias("episodes"), F.min("onset_at").alias("onset_at"), F.min(F.struct((-F.coalesce("peak_value", F.lit(-1.0))).alias("v"), F.col("peak_at").alias("at")))["at"].alias("peak_at"),
        F.min(F.struct(F.coalesce("trough_value", F.lit(2.0)).alias("v"), F.col("trough_at").alias("at")))["at"].alias("trough_at"), last.alias("last"), F.collect_set("duration_state").alias("states"),
    )
    ends = observations.groupBy("subject").agg(F.max("observed_at").alias("observation_end_at"))
    joined = ends.join(sums, "subject", "left")
    state = F.when(F.array_contains("states", "lower_bound"), "lower_bound").when(F.array_contains("states", "interval"), "interval").when(F.col("states").isNotNull(), "exact").otherwise("unknown")
    return joined.select(
        "subject", F.coalesce("episodes", F.lit(0)).alias("episodes"), "onset_at", "peak_at", "trough_at", F.col("last.partial_recovery_at").alias("partial_recovery_at"), F.col("last.full_recovery_at").alias("full_recovery_at"),
        "observation_end_at", state.alias("duration_state"), F.coalesce("last.recovery_state", F.lit("unknown")).alias("recovery_state"),
    )
