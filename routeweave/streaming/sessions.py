"""Routes of vantage points whose sessions come and go, as a stream with state and timers.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import SETTLE

REPORT = "vp string, bucket int, at bigint, report string, known bigint, unknown bigint"
#: Provider of the state store that keeps a vantage point's routes on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionRoutes(StatefulProcessor):
    """Of one bucket of a vantage point: its routes with the time they were last announced, and how many of them are known or unknown. A loss touches
    no route: those announced before it are unknown. A timer settles a new session when nothing else comes."""

    def __init__(self, settle: int = SETTLE):
        self.settle = settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.routes = handle.getMapState("routes", "prefix string", "at bigint, ordinal bigint")
        self.session = handle.getValueState("session", "lost_at bigint, lost_ordinal bigint, known bigint, unknown bigint, settle_at bigint, at bigint, ordinal bigint")

    def _held(self) -> list[int]:
        return list(self.session.get()) if self.session.exists() else [-1, -1, 0, 0, -1, -1, -1]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        """A route of the seed: (vp, bucket, prefix, at, ordinal)."""
        held = self._held()
        for prefix, at, ordinal in zip(initialState["prefix"], initialState["at"], initialState["ordinal"], strict=True):
            if not self.routes.containsKey((prefix,)):
                held[2] += 1
            self.routes.updateValue((prefix,), (int(at), int(ordinal)))
            held[5:] = max((held[5], held[6]), (int(at), int(ordinal)))
        self.session.update(tuple(held))

    def _settled(self, key: tuple, held: list[int]) -> tuple:
        row = (*key, held[4], "settled", held[2], held[3])
        held[5:], held[4] = max((held[5], held[6]), (held[4], 1 << 62)), -1
        return row

    def _clear_timer(self, held: list[int]) -> None:
        if held[4] >= 0:
            self.handle.deleteTimer(held[4] * 1000)
            held[4] = -1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self._held(), []
        batch = pd.concat(list(rows)).sort_values(["at", "ordinal"], kind="stable")
        for at, ordinal, kind, prefix in zip(batch["at"].tolist(), batch["ordinal"].tolist(), batch["kind"], batch["prefix"], strict=True):
            if (at, ordinal) < (held[5], held[6]):
                out.append((*key, at, "rejected_late", held[2], held[3]))
                continue
            if 0 <= held[4] < at:
                due = held[4]
                out.append(self._settled(key, held))
                self.handle.deleteTimer(due * 1000)
            held[5:] = at, ordinal
            if kind in ("lost", "up"):
                self._clear_timer(held)
                out.append((*key, at, kind, held[2], held[3]))
                if kind == "lost":
                    held[0], held[1], held[3], held[2] = at, ordinal, held[3] + held[2], 0
                else:
                    held[4] = at + self.settle
                    self.handle.registerTimer(held[4] * 1000)
                continue
            if self.routes.containsKey((prefix,)):
                held[2 if tuple(self.routes.getValue((prefix,))) > (held[0], held[1]) else 3] -= 1
            if kind == "announce":
                held[2] += 1
                self.routes.updateValue((prefix,), (at, ordinal))
            elif self.routes.containsKey((prefix,)):
                self.routes.removeKey((prefix,))
        self.session.update(tuple(held))
        yield pd.DataFrame(out, columns=["vp", "bucket", "at", "report", "known", "unknown"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self._held(), []
        if held[4] >= 0 and expiredTimerInfo.getExpiryTimeInMs() == held[4] * 1000:
            out.append(self._settled(key, held))
            self.session.update(tuple(held))
        yield pd.DataFrame(out, columns=["vp", "bucket", "at", "report", "known", "unknown"])

    def close(self) -> None:
        pass


def live_sessions(rows: DataFrame, seed: DataFrame | None = None, late: str = "0 seconds", settle: int = SETTLE) -> DataFrame:
    """The reports of ``session_reports`` for each bucket as they happen; a row older than the last applied is rejected and says so, unless it is
    behind the watermark (``late``), where Spark drops it.

    ``rows``: of ``timeline``, streaming; ``seed``: routes (vp, bucket, prefix, at, ordinal) to start from, such as ``catch_up`` gives, before which nothing is reported.
    """
    timed = rows.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    start = None if seed is None else seed.select("vp", "bucket", "prefix", "at", "ordinal").groupBy("vp", "bucket")
    return timed.groupBy("vp", "bucket").transformWithStateInPandas(SessionRoutes(settle), REPORT, "Append", "EventTime", initialState=start)
