import json
import os

from routeweave.operators import state
from routeweave.sources import updates
from routeweave.streaming import routes


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"B|{t}|{f}|ip|{peer}|{prefix}|{path}\n" for t, f, peer, prefix, path in rows))
    os.utime(folder / name, (1_700_000_000 + 100 * ord(name),) * 2)  # the order of arrival


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


ONE = [(1000, "A", "1", "10.0.0.0/24", "1 2"), (1010, "W", "1", "10.0.0.0/24", ""), (1020, "A", "1", "10.0.0.0/24", "1 3"), (1005, "A", "2", "10.0.0.0/24", "2 2")]
TWO = [(1400, "A", "1", "10.0.0.0/24", "1 4"), (900, "A", "1", "10.0.0.0/24", "1 9"), (1500, "W", "2", "10.0.0.0/24", "")]


def test_replay_equals_batch_and_rejects_late(spark, tmp_path):
    write(tmp_path / "in", "a", ONE)
    write(tmp_path / "in", "b", TWO)
    out = run(routes.route_transitions(updates.stream_updates(spark, str(tmp_path / "in"))), "transitions", tmp_path)
    got = [(r["peer_asn"], r["epoch_s"], r["change"]) for r in out.orderBy("peer_asn", "epoch_s").collect()]
    assert ("1", 900, "rejected_late") in got and ("1", 1400, "replaced") in got and ("2", 1500, "withdrawn") in got
    applied = out.filter("change <> 'rejected_late'").selectExpr("*", "CASE WHEN as_path IS NULL THEN 'withdraw' ELSE 'announce' END AS action")
    assert [(r["peer_asn"], r["as_path"]) for r in state.replay(applied, ["prefix", "peer_asn"], ["epoch_s"]).collect()] == [("1", "1 4")]


def test_slot_counts(spark, tmp_path):
    write(tmp_path / "in", "a", [(0, "A", "1", "p/24", "1"), (299, "W", "1", "p/24", ""), (300, "A", "1", "p/24", "1")])
    write(tmp_path / "in", "b", [(5000, "A", "1", "p/24", "1")])
    write(tmp_path / "in", "c", [(9000, "A", "1", "p/24", "1")])
    out = run(routes.slot_counts(updates.stream_updates(spark, str(tmp_path / "in"))), "slots", tmp_path)
    got = {r["slot"]: (r["announces"], r["withdraws"]) for r in out.collect()}
    assert got[0] == (1, 1) and got[300] == (1, 0)


def test_country_outage_lifecycle(spark, tmp_path):
    (tmp_path / "s").mkdir()
    ratios = [0.0, 0.05, None, 0.04, 0.1, 0.2, 0.0] + [0.0] * 8
    shares = [(1.0, 1.0)] * 6 + [(0.995, 0.98)] + [(1.0, 1.0), (1.0, None)] + [(0.99, 0.99)] * 6
    rows = [{"country": "XX", "epoch_s": 300 * i, "ratio": r, "asn_visible": a, "prefix_visible": p} for i, (r, (a, p)) in enumerate(zip(ratios, shares))]
    (tmp_path / "s" / "a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    samples = spark.readStream.schema("country string, epoch_s bigint, ratio double, asn_visible double, prefix_visible double").json(str(tmp_path / "s"))
    out = run(routes.country_outages(samples), "countries", tmp_path)
    assert [tuple(r) for r in out.orderBy("at_s", "event").collect()] == [("XX", "opened", 900, 1200, 0.1), ("XX", "peak", 900, 1500, 0.2), ("XX", "closed", 900, 2700, 0.2)]


def test_country_outages_reject_older_observations_after_a_restart(spark, tmp_path):
    """The second batch is a new run from the checkpoint; what it has from before the first changes nothing."""
    (tmp_path / "s").mkdir()
    schema = "country string, epoch_s bigint, ratio double, asn_visible double, prefix_visible double"

    def batch(name, rows, stamp):
        text = "".join(json.dumps({"country": "XX", "epoch_s": t, "ratio": r, "asn_visible": 0.5, "prefix_visible": 0.5}) + "\n" for t, r in rows)
        (tmp_path / "s" / name).write_text(text)
        os.utime(tmp_path / "s" / name, (stamp, stamp))
        out = routes.country_outages(spark.readStream.schema(schema).json(str(tmp_path / "s")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    batch("a.json", [(300, 0.05), (600, 0.06)], 1_700_000_000)
    batch("b.json", [(450, 0.9), (600, 0.9), (900, 0.2)], 1_700_000_100)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at_s", "event").collect()
    assert [(r["event"], r["start_s"], r["at_s"], r["peak"]) for r in got] == [("rejected_late", 300, 450, 0.9), ("opened", 300, 600, 0.06), ("rejected_late", 300, 600, 0.9), ("peak", 300, 900, 0.2)]


def test_replay_goes_on_after_a_restart(spark, tmp_path):
    """Two runs over one checkpoint give what one run gives."""
    write(tmp_path / "in", "a", ONE)
    one = routes.route_transitions(updates.stream_updates(spark, str(tmp_path / "in")))
    for name in ("a", "b"):
        if name == "b":
            write(tmp_path / "in", "b", TWO)
        q = one.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r["peer_asn"], r["epoch_s"], r["change"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("1", 900, "rejected_late"), ("1", 1000, "announced"), ("1", 1010, "withdrawn"), ("1", 1020, "announced"), ("1", 1400, "replaced"), ("2", 1005, "announced"), ("2", 1500, "withdrawn")]
