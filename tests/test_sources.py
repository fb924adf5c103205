import gzip

import pytest
from pyspark.sql import functions as F

from routeweave.sources import dims, sinks, updates

LINES = """BGP4MP|100|A|10.0.0.1|64500|192.0.2.0/24|64500 3356 15169
BGP4MP|101|W|10.0.0.1|64500|192.0.2.0/24|
BGP4MP|101|A|10.0.0.1|64500|0.0.0.0/0|64500
BGP4MP|102|STATE|10.0.0.1|64500|6|1
BGP4MP|103|A|10.0.0.1|64500|198.51.100.0/24|64500 {1,2}
BGP4MP|x|A|10.0.0.1|64500|198.51.100.0/24|64500 1
short|line
BGP4MP|104|A|10.0.0.2|64501|192.0.2.0/24|64501 15169
"""


@pytest.fixture()
def update_dir(tmp_path):
    d = tmp_path / "updates"
    d.mkdir()
    (d / "updates.20260227.0805.gz").write_bytes(gzip.compress(LINES.encode()))
    return str(d)


def test_updates_and_rejects(spark, update_dir):
    routes, rejected = updates.read_updates(spark, update_dir)
    assert [(r["epoch_s"], r["action"], r["peer_asn"]) for r in routes.orderBy("line").collect()] == [(100, "announce", "64500"), (101, "withdraw", "64500"), (104, "announce", "64501")]
    assert sorted(r["reason"] for r in rejected.collect()) == ["as_set", "bad_time", "default_route", "session_state", "too_few_fields"]


def test_rib_and_prior_path(spark, tmp_path, update_dir):
    (tmp_path / "rib").write_text("T|1|B|p|64501|192.0.2.0/24|64501 9\nT|1|B|p|64501|192.0.2.0/24|64501 8\nT|1|B|p|1\n")
    rib = updates.read_rib(spark, str(tmp_path / "rib"))
    assert [(r["prefix"], r["as_path"], r["origin"]) for r in rib.collect()] == [("192.0.2.0/24", "64501 8", "8")]
    prior = updates.with_prior_path(updates.read_updates(spark, update_dir)[0], rib)
    got = {(r["peer_asn"], r["epoch_s"]): r["prior_path"] for r in prior.collect()}
    assert got == {("64500", 100): None, ("64500", 101): "64500 3356 15169", ("64501", 104): "64501 8"}


def test_archive_inventory(spark, tmp_path):
    for t in ("0800", "0805", "0820"):
        (tmp_path / f"updates.20260227.{t}.gz").write_bytes(b"x")
    files, missing = updates.archive_inventory(spark, str(tmp_path))
    assert files.count() == 3
    first = files.agg(F.min("slot")).first()[0]
    assert sorted(r["slot"] - first for r in missing.collect()) == [600, 900]


def test_dims(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 3)], "asn bigint, name string, n int")
    assert sorted(map(tuple, dims.first_per_key(df, "asn", "n").select("asn", "name").collect())) == [(1, "a"), (2, None)]
    edges = dims.relation_edges(spark.createDataFrame([(1, '{"peer":["2","x"],"peers":["3"],"other":["4"]}')], "asn bigint, rel string"), "asn", "rel")
    assert sorted((r["relation"], r["target"] or -1, r["flag"] or "") for r in edges.collect()) == [("other", 4, "unknown_relation"), ("peer", -1, "bad_target"), ("peer", 2, ""), ("peers", 3, "ambiguous_relation_name")]
    good, bad = dims.screened(df, {"no_name": F.col("name").isNull(), "big": F.col("n") > 2})
    assert good.count() == 2 and bad.first()["quality_flags"] == ["no_name", "big"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b'{"a":1,"b":"x"}\n{"a":2}\n'))
    assert sorted(map(tuple, dims.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "a int, b string").collect())) == [(1, "x"), (2, None)]
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    assert dims.read_csv_checked(spark, str(tmp_path / "a.csv"), "a int, b string", ["a"]).first()["b"] == "x"
    with pytest.raises(ValueError, match="c"):
        dims.read_csv_checked(spark, str(tmp_path / "a.csv"), "a int, b string", ["c"])


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "k bigint, v string, version int")
    rows = spark.createDataFrame([(2, "new", 2), (3, "new", 1), (1, "late", 0)], "k bigint, v string, version int")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(table, rows, ["k"], "version").collect()) == [(1, "old"), (2, "new"), (3, "new")]
    assert sorted((r["k"], r["v"]) for r in sinks.append_absent(table, rows, ["k"]).collect()) == [(1, "old"), (2, "old"), (3, "new")]
    events = spark.createDataFrame([(1, 10, None, None), (2, 10, 12, 2)], "id bigint, start_s bigint, end_s bigint, duration_s bigint")
    ends = spark.createDataFrame([(1, 15), (2, 99)], "id bigint, closed_s bigint")
    assert sorted(map(tuple, sinks.close_events(events, ends, "id").collect())) == [(1, 10, 15, 5), (2, 10, 12, 2)]
    at = spark.createDataFrame([(1, 1704067200), (2, 1706745600)], "id bigint, at bigint")
    sinks.write_monthly(at, str(tmp_path / "m"), "at")
    sinks.write_monthly(at.filter("id = 2").withColumn("id", F.lit(5).cast("bigint")), str(tmp_path / "m"), "at")
    assert sorted((r["ym"], r["id"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(202401, 1), (202402, 5)]


def test_keyed_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int, n int")
    assert sinks.read_table(spark, path) is None
    sinks.append_absent_to(path, rows(("a", 2, 1), ("a", 1, 9), ("b", 5, 0)), ["k"])
    sinks.append_absent_to(path, rows(("a", 0, 0), ("c", 7, 7)), ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [("a", 1, 9), ("b", 5, 0), ("c", 7, 7)]
    (tmp_path / "t" / "v=2").mkdir()  # a write that did not end
    sinks.upsert_to(path, rows(("a", 3, 1), ("a", 3, 2), ("b", 4, 4)), ["k"], "v")
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [("a", 3, 2), ("b", 5, 0), ("c", 7, 7)]
    assert sinks.whole_versions(spark, path) == [1, 2]


def test_event_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "e")
    table = spark.createDataFrame([(1, 10, None, None, 0.2), (2, 20, 30, 10, 0.5)], "id int, start_s bigint, end_s bigint, duration_s bigint, peak double")
    sinks.write_table(table, path)
    peaks = spark.createDataFrame([(1, 0.1), (1, 0.7), (2, 0.9)], "id int, peak double")
    sinks.write_table(sinks.raise_peaks(sinks.read_table(spark, path), peaks, "id", "peak"), path)
    sinks.close_events_in(path, spark.createDataFrame([(1, 50), (1, 40), (2, 99)], "id int, closed_s bigint"), "id")
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, 10, 40, 30, 0.7), (2, 20, 30, 10, 0.5)]


def test_monthly_tables_are_pruned(spark, tmp_path):
    path, day = str(tmp_path / "m"), 86400
    df = spark.createDataFrame([(c, d * day, d) for c in ("aa", "bb") for d in range(0, 120, 5)], "country string, at_s bigint, v int")
    sinks.write_monthly(df, path, "at_s", ["country"])
    got = sinks.read_months(spark, path, "at_s", 35 * day, 45 * day)
    assert sorted((r["country"], r["v"]) for r in got.collect()) == [(c, d) for c in ("aa", "bb") for d in (35, 40, 45)]
    assert all("ym=197002" in f for f in got.inputFiles()) or "PartitionFilters: [isnotnull(ym" in got._jdf.queryExecution().toString()
    sinks.write_monthly(df.filter("country = 'aa' AND at_s < 864000").withColumn("v", F.lit(-1)), path, "at_s", ["country"])
    after = sinks.read_months(spark, path, "at_s", 0, 200 * day).groupBy("country").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()
    assert sorted(map(tuple, after)) == [("aa", 19, -1), ("bb", 24, 0)]
