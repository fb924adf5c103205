"""Peer sessions in batch and as a stream."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routeweave.operators import sessions
from routeweave.sources import updates
from routeweave.streaming import sessions as live

ROWS = "vp string, at bigint, ordinal bigint, action string, prefix string, as_path string"
TURNS = "vp string, at bigint, ordinal bigint, old_state int, new_state int"


def drawn(seed, n=400):
    draw = random.Random(seed)
    routes, turns, up = [], [], {"a": True, "b": True}
    for k in range(n):
        vp, at = draw.choice("aab"), 30 * k + draw.randrange(30)
        if draw.random() < 0.06:
            turns.append((vp, at, k, 6, draw.choice([1, 2]))) if up[vp] else turns.append((vp, at, k, 5, 6))
            up[vp] = not up[vp]
        elif draw.random() < 0.05:
            turns.append((vp, at, k, 2, 3))
        else:
            routes.append((vp, at, k, draw.choice(["announce", "announce", "withdraw"]), f"10.0.{draw.randrange(25)}.0/24", "1 2"))
    return routes, turns


def brute(routes, turns, settle):
    events = sorted([(at, o, vp, "route", action, prefix) for vp, at, o, action, prefix, _ in routes] + [(at, o, vp, "turn", old, new) for vp, at, o, old, new in turns])
    known, lost, due, out = defaultdict(dict), {}, {}, []

    def counts(vp):
        fresh = sum(x > lost.get(vp, (-1, -1)) for x in known[vp].values())
        return fresh, len(known[vp]) - fresh

    for at, o, vp, kind, x, y in [*events, (1 << 60, 0, "a", "end", 0, 0), (1 << 60, 0, "b", "end", 0, 0)]:
        if vp in due and due[vp] < at:
            out.append((vp, due.pop(vp), "settled", *counts(vp)))
        if kind == "route":
            if x == "withdraw":
                known[vp].pop(y, None)
            else:
                known[vp][y] = (at, o)
        elif kind == "turn" and (x == 6) != (y == 6):
            due.pop(vp, None)
            out.append((vp, at, "lost" if x == 6 else "up", *counts(vp)))
            if x == 6:
                lost[vp] = (at, o)
            else:
                due[vp] = at + settle
    return sorted(out)


@pytest.mark.parametrize("buckets", [1, 5])
def test_reports_in_batch(spark, buckets):
    routes, turns = drawn(1)
    rows = sessions.timeline(spark.createDataFrame(routes, ROWS), spark.createDataFrame(turns, TURNS), buckets)
    got = sessions.session_reports(rows, 300).select("vp", "at", "report", "known", "unknown").collect()
    want = brute(routes, turns, 300)
    assert {r[2] for r in want} == {"lost", "up", "settled"} and any(r[4] for r in want if r[2] == "settled")
    assert sorted(map(tuple, got)) == want


def test_a_lost_session_is_no_withdrawal(spark):
    routes = [("a", 10, 1, "announce", "p", "1"), ("a", 10, 2, "announce", "q", "1"), ("a", 200, 5, "announce", "q", "1")]
    turns = [("a", 100, 3, 6, 1), ("a", 150, 4, 5, 6), ("a", 160, 6, 3, 4)]
    rows = sessions.timeline(spark.createDataFrame(routes, ROWS), spark.createDataFrame(turns, TURNS), 2)
    got = sessions.session_reports(rows, 60).select("at", "report", "known", "unknown").collect()
    assert sorted(map(tuple, got)) == [(100, "lost", 2, 0), (150, "up", 0, 2), (210, "settled", 1, 1)]


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Rows come in files; the query is stopped between them and goes on from its checkpoint. A seed is there before the first."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.PROVIDER)
    try:
        routes, turns = drawn(2, 300)
        seed = [("a", 1, k, "announce", f"10.0.{k}.0/24", "1 2") for k in range(10)]
        routes = [(vp, at + 100, o + 100, *rest) for vp, at, o, *rest in routes]
        turns = [(vp, at + 100, o + 100, *rest) for vp, at, o, *rest in turns]
        last = [("a", 50_000, 9000, "announce", "10.9.9.0/24", "1"), ("b", 50_000, 9001, "announce", "10.9.9.0/24", "1")]
        start = sessions.timeline(spark.createDataFrame(seed, ROWS), spark.createDataFrame([], TURNS), 3)
        rows = sorted((r.asDict() for r in sessions.timeline(spark.createDataFrame(routes + last, ROWS), spark.createDataFrame(turns, TURNS), 3).collect()), key=lambda r: (r["at"], r["ordinal"]))
        folder = tmp_path / "in"
        folder.mkdir()
        schema = "vp string, bucket int, at bigint, ordinal bigint, kind string, prefix string, as_path string"

        def run(name, rows, stamp):
            (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
            os.utime(folder / name, (stamp, stamp))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
            out = live.live_sessions(stream, start, settle=300)
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None

        cut = next(k for k in range(len(rows) // 2, len(rows)) if rows[k]["at"] != rows[k - 1]["at"])
        run("a", rows[:cut], 1_700_000_000)
        late = {"vp": "a", "bucket": 0, "at": 150, "ordinal": 0, "kind": "announce", "prefix": "10.0.99.0/24", "as_path": "1"}
        run("b", rows[cut:], 1_700_000_100)
        run("c", [late], 1_700_000_200)
        got = spark.read.parquet(str(tmp_path / "out"))
        told = got.filter("report <> 'rejected_late'").groupBy("vp", "at", "report").agg(F.sum("known").alias("known"), F.sum("unknown").alias("unknown"))
        assert sorted(map(tuple, told.collect())) == brute(seed + routes + last, turns, 300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_catch_up(spark):
    rib = [("a", "p", 50, 1, "announce", "1"), ("a", "q", 60, 2, "announce", "2"), ("b", "p", 70, 3, "announce", "3")]
    moved = [("a", "p", 40, 9, "withdraw", None), ("a", "r", 80, 4, "announce", "4"), ("a", "r", 90, 5, "announce", "5"), ("b", "q", 95, 6, "announce", "6"), ("b", "p", 100, 7, "withdraw", None)]
    schema = "vp string, prefix string, at bigint, ordinal bigint, action string, as_path string"
    gaps = spark.createDataFrame([("b", 60, 70, "missing_artifact"), ("b", 80, 90, "bad_artifact"), ("a", 100, 200, "later")], "vp string, missing_from bigint, missing_to bigint, reason string")
    got = sessions.catch_up(spark.createDataFrame(rib, schema), spark.createDataFrame(moved, schema), gaps, 100).select("vp", "prefix", "as_path", "continuity", "missing_reasons").collect()
    assert sorted(map(tuple, got)) == [
        ("a", "q", "2", "continuous", []), ("a", "r", "5", "continuous", []),
        ("b", "p", "3", "unknown_after_gap", ["bad_artifact", "missing_artifact"]), ("b", "q", "6", "unknown_after_gap", ["bad_artifact", "missing_artifact"]),
    ]


def test_session_lines(spark, tmp_path):
    (tmp_path / "u").write_text("B|5|STATE|ip|1|6|1\nB|6|STATE|ip|1|1|7\nB|7|A|ip|1|10.0.0.0/24|1 2\nB||STATE|ip|1|1|2\n")
    rows, rejected = updates.read_sessions(spark, str(tmp_path))
    assert [(r["epoch_s"], r["old_state"], r["new_state"]) for r in rows.collect()] == [(5, 6, 1)] and rejected.count() == 2
    names = spark.range(0, 8).select(sessions.state_name(F.col("id")).alias("x")).filter("id > 0").collect()
    assert [r["x"] for r in names] == [*sessions.FSM, None]
