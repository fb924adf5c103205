"""Streaming twins of the state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITION = "prefix string, peer_asn string, epoch_s bigint, prior_path string, as_path string, change string"


def slot_counts(events: DataFrame, late: str = "5 minutes", slot: str = "5 minutes") -> DataFrame:
    """Announcements and withdrawals of each peer in half-open slots; a slot is emitted once the watermark has passed it."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", slot), "peer_asn")
    counts = windows.agg(F.count_if(F.col("action") == "announce").alias("announces"), F.count_if(F.col("action") == "withdraw").alias("withdraws"))
    return counts.select(F.unix_timestamp("window.start").alias("slot"), "peer_asn", "announces", "withdraws")


def without_repeats(events: DataFrame, keys: list[str], late: str = "5 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def route_transitions(events: DataFrame) -> DataFrame:
    """State replay: what each update changes on its (prefix, peer). Rows of a batch are put in time order; one that is older than the
    last applied is rejected and says so."""

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, path = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values(["epoch_s", "file"], kind="stable")
        out = []
        for t, action, new in zip(rows["epoch_s"], rows["action"], rows["as_path"]):
            new = None if action == "withdraw" or pd.isna(new) else new
            if t < last:
                out.append((*key, t, path, path, "rejected_late"))
                continue
            change = "unchanged" if new == path else "withdrawn" if new is None else "announced" if path is None else "replaced"
            out.append((*key, t, path, new, change))
            last, path = t, new
        state.update((int(last), path))
        yield pd.DataFrame(out, columns=["prefix", "peer_asn", "epoch_s", "prior_path", "as_path", "change"])

    keyed = events.groupBy("prefix", "peer_asn")
    return keyed.applyInPandasWithState(apply, TRANSITION, "last bigint, path string", "append", GroupStateTimeout.NoTimeout)


def country_outages(samples: DataFrame, start: float = 0.03, back: float = 0.99, onset: int = 2, recovery: int = 6) -> DataFrame:
    """Live country outages. ``samples``: (country, epoch_s, ratio of ASes affected, asn_visible, prefix_visible). ``onset``
    observations in a row above ``start`` open one, with the first of them as its onset; an observation without a ratio is not
    above. ``recovery`` in a row in which both visible shares are observed and at least ``back`` close it at the first of them.
    Emits a row when an outage opens, has a new peak, or closes; an observation that is not newer than the last applied one changes nothing and is emitted as ``rejected_late``."""

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bad, first, opened, peak, good, back_at, last = state.get if state.exists else (0, -1, -1, 0.0, 0, -1, -1)
        out = []
        columns = ["epoch_s", "ratio", "asn_visible", "prefix_visible"]
        for t, ratio, asns, prefixes in pd.concat(list(batches)).sort_values("epoch_s", kind="stable")[columns].itertuples(index=False):
            if t <= last:
                out.append((*key, "rejected_late", opened, t, ratio))
                continue
            last = t
            above = not pd.isna(ratio) and ratio > start
            if opened < 0:
                bad, first = (bad + 1, first if bad else t) if above else (0, -1)
                if bad >= onset:
                    opened, peak, good = first, ratio, 0
                    out.append((*key, "opened", opened, t, peak))
                continue
            if not pd.isna(ratio) and ratio > peak:
                peak = ratio
                out.append((*key, "peak", opened, t, peak))
            whole = not pd.isna(asns) and not pd.isna(prefixes) and asns >= back and prefixes >= back
            good, back_at = (good + 1, back_at if good else t) if whole else (0, -1)
            if good >= recovery:
                out.append((*key, "closed", opened, back_at, peak))
                bad, first, opened, peak, good, back_at = 0, -1, -1, 0.0, 0, -1
        state.update((int(bad), int(first), int(opened), float(peak), int(good), int(back_at), int(last)))
        yield pd.DataFrame(out, columns=["country", "event", "start_s", "at_s", "peak"])

    schema, held = "country string, event string, start_s bigint, at_s bigint, peak double", "bad int, first bigint, opened bigint, peak double, good int, back_at bigint, last bigint"
    return samples.groupBy("country").applyInPandasWithState(apply, schema, held, "append", GroupStateTimeout.NoTimeout)
