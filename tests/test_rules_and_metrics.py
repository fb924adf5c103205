"""Rule chains, metric series, records with outliers, feature rows and sinks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from routeweave.operators import judgements, metrics, resources, series
from routeweave.sources import sinks


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


INFO = "asn string, org string, org_en string, shield boolean, imports array<string>, exports array<string>, peers array<string>, siblings array<string>"


def info(spark):
    blank = (None, None, False, [], [], [], [])
    named = {
        "1": ("one", "x", False, ["AS9"], [], [], []), "2": ("two", "y", False, [], [], [], []), "3": ("three", "y", False, [], [], [], []), "4": ("某个人", None, False, [], [], [], []), "5": ("five", None, True, [], [], [], []),
        "6": ("six", None, False, [], [], ["8", "6"], []), "7": ("seven", None, False, [], ["AS2"], [], ["8"]), "8": ("eight", None, False, [], [], [], []), "9": ("nine", None, False, [], [], [], []), "10": ("未知组织", None, False, [], [], [], []), "11": blank, "12": blank,
    }
    return spark.createDataFrame([(k, *v) for k, v in named.items()], INFO)


@pytest.mark.parametrize(("origins", "first", "verdict"), [
    (["1", "2", "3"], "1", "moas num more than 2"), (["1", "abc"], "1", "invalid asn"), (["1", ""], "1", "invalid asn"), (["1", "{2,3}"], "1", "as_set"), (["1", "64512"], "1", "private as"), (["1", "4200000000"], "1", "private as"),
    (["1", "64511"], "1", "possible hijack"), (["2", "4"], "2", "personal network or unknown org"), (["10", "2"], "2", "personal network or unknown org"), (["1", "9"], "1", "1 import filter 9"), (["1", "9"], "9", "1 import filter 9"), (["2", "7"], "2", "7 export filter 2"),
    (["1", "2"], "1", "as rel provider-customer"), (["1", "3"], "3", "as rel peer"), (["8", "9"], "8", "as rel same org"), (["2", "3"], "2", "as rel same org"), (["1", "8"], "1", "pboth in moasset"), (["2", "5"], "2", "5 is AntiDDoS provider"),
    (["6", "8"], "6", "peer"), (["7", "8"], "7", "siblings"), (["11", "12"], "11", "possible hijack"), (["2", "8"], "2", "possible hijack"),
])
def test_conflict_rules(spark, origins, first, verdict):
    edges = spark.createDataFrame([("1", "2", 1), ("3", "1", 0)], "a string, b string, rel int")
    siblings = spark.createDataFrame([("9", "8")], "a string, b string")
    history = spark.createDataFrame([("p", "1"), ("p", "8"), ("q", "2"), ("q", "8")], "prefix string, asn string")
    none = spark.createDataFrame([], "prefix string, asn string")
    conflict = spark.createDataFrame([("p", origins, first)], "prefix string, origins array<string>, first_origin string")
    (got,) = judgements.judge_conflicts(conflict, info(spark), edges, siblings, none, history).collect()
    assert got["verdict"] == verdict
    if got["owner"]:
        assert (got["owner"], got["suspect"]) == (first, next(x for x in origins if x != first))


def test_registered_origins_clear_too(spark):
    edges = spark.createDataFrame([("2", "9", 1)], "a string, b string, rel int")
    none = spark.createDataFrame([], "a string, b string")
    registered = spark.createDataFrame([("p", "2"), ("p", "1"), ("p", "8"), ("q", "3")], "prefix string, asn string")
    conflict = spark.createDataFrame([("p", ["8", "9"], "8"), ("q", ["8", "9"], "8")], "prefix string, origins array<string>, first_origin string")
    got = rows_of(judgements.judge_conflicts(conflict, info(spark), edges, none, registered, registered.limit(0)), "prefix", "verdict")
    assert got == [("p", "1 import filter 9"), ("q", "possible hijack")]  # of the registered ones the first in order that clears it


def test_leak_rules(spark):
    pairs = [("1", "1", "by equal to"), ("1", "4", "personal network"), ("10", "2", "unknown org"), ("11", "12", "org equal"), ("99", "98", "org equal"), ("1", "{2}", "as set"), ("1", "64511", "private as"), ("1", "9", "1 import filter 9"), ("2", "7", "7 export filter 2"), ("2", "8", "possible leak"), ("2", "4294967296", "private as"), ("2", "4200000000", "possible leak")]
    got = judgements.judge_leaks(spark.createDataFrame([p[:2] for p in pairs], "leak_by string, leak_to string"), info(spark))
    assert rows_of(got) == sorted(pairs, key=repr)


SLOTS = [("s", 0, "available"), ("s", 1, "available"), ("s", 2, "parse_failed"), ("s", 3, None), ("s", 4, "processing_gap"), ("s", 5, "legacy_unknown"), ("s", 6, "available"), ("s", 7, "available")]
ROWS = "subject string, slot int, announces int, withdraws int, v4 int, samples array<int>"


def points(spark, kind, sparse=False):
    rows = [("s", 0, 3, 1, 5, [1, 4]), ("s", 1, 0, 0, None, []), ("s", 2, 9, 9, 9, [9]), ("s", 3, 9, 9, 9, [9]), ("s", 7, 2, 0, 0, [0])]
    return metrics.metric_points(spark.createDataFrame(rows, ROWS), spark.createDataFrame(SLOTS, "subject string, slot int, class string"), kind, sparse)


def test_metric_points(spark):
    missing = ["parse_failed", "source_unavailable", "processing_gap", "legacy_unknown"]

    def states(kind, sparse=False):
        got = rows_of(points(spark, kind, sparse), "slot", "value", "value_state", "missing_reason")
        assert [r[2] for r in got[2:6]] == missing and all(r[1] is None for r in got[2:6])
        return [r[1:] for r in (*got[:2], *got[6:])]

    assert states("withdraw_ratio") == [(0.25, "observed_nonzero", None), (None, "not_applicable", "denominator_zero"), (None, "row_missing", "row_missing"), (0.0, "observed_zero", None)]
    assert states("update_total", True) == [(4.0, "observed_nonzero", None), (0.0, "observed_zero", None), (0.0, "observed_zero", None), (2.0, "observed_nonzero", None)]
    assert states("v4") == [(5.0, "observed_nonzero", None), (None, "not_observed", "not_observed"), (None, "not_observed", "not_observed"), (0.0, "observed_zero", None)]
    assert states("concurrency") == [(4.0, "observed_nonzero", None), (None, "legacy_unknown", "legacy_unknown"), (None, "row_missing", "row_missing"), (0.0, "observed_zero", None)]
    with pytest.raises(ValueError, match="sparse"):
        points(spark, "v4", True)
    (c,) = metrics.metric_coverage(points(spark, "withdraw_ratio")).collect()
    assert (c["expected"], c["source_observed"], c["metric_observed"], c["active"], c["processing_gaps"], c["source_gaps"], c["source_ratio"], c["density"]) == (8, 6, 2, 3, 1, 2, 0.75, 0.5)


def test_metric_checks(spark):
    true = points(spark, "withdraw_ratio").withColumn("missing_reason", F.when(F.col("value_state") == "row_missing", "not_observed").otherwise(F.col("missing_reason"))).withColumn("value_state", F.when(F.col("value_state") == "row_missing", "not_observed").otherwise(F.col("value_state")))
    assert {r[2] for r in rows_of(metrics.metric_checks(true, true, 1))} == {0}
    told = true.withColumn("value", F.when(F.col("slot") == 0, 0.5).when(F.col("slot") == 4, 0.0).otherwise(F.col("value"))).filter("slot <> 3")
    assert rows_of(metrics.metric_checks(told, true, 1), "check", "violations") == [("formula", 1), ("missing_state", 1), ("no_zero_fill", 1), ("slot_closure", 2), ("source_points", 3)]


def test_country_samples(spark):
    a, b = spark.createDataFrame([(1, 5)], "slot int, x int"), spark.createDataFrame([(1, 7), (2, None)], "slot int, y int")
    assert rows_of(metrics.country_samples([a, b], ["slot"])) == [(1, 5, 7, ["x", "y"]), (2, None, None, [])]


def test_one_outlying_count_marks_the_record(spark):
    rows = [("k", 3600 * i, 10.0, 20.0) for i in range(8)] + [("k", 3600 * 8, 10.0, 90.0), ("k", 3600 * 9, 10.0, 20.0), ("k", 3600 * 10, None, 20.0)]
    df = spark.createDataFrame(rows, "k string, t bigint, a double, b double")
    got = series.outlier_records(df, ["k"], "t", ["a", "b"]).orderBy("t").collect()
    assert [r["outlier"] for r in got] == [False] * 8 + [True, False, False]
    assert (got[8]["low_a"], got[8]["high_a"], got[8]["low_b"], got[8]["high_b"]) == (8, 12, 16, 24)
    alone = series.outlier_band(df.select("k", "t", F.col("a").alias("v")), ["k"], "t", "v").orderBy("t").collect()
    assert not any(r["outlier"] for r in alone)


EVENTS = "vp int, prefix string, afi int, network bigint, length int, slot int, action string, origin int, o int"


def test_feature_rows(spark):
    v4 = lambda p, n, length: (p, 4, n, length)
    a, b, c, six = v4("10.0.0.0/23", 10 << 24, 23), v4("10.0.1.0/24", (10 << 24) + 256, 24), v4("11.0.0.0/7", 10 << 24, 7), ("2001:db8::/47", 6, 0x20010DB8 << 16, 47)
    rows = [(1, *a, 0, "announce", 1, 1), (2, *b, 0, "announce", 2, 2), (1, *c, 0, "announce", 1, 3), (1, *six, 1, "announce", 1, 4), (1, *a, 2, "withdraw", None, 5), (2, *b, 3, "announce", 1, 6)]
    countries = spark.createDataFrame([(1, "X"), (2, "X")], "asn int, country string")
    got = {r[:3]: r[3:] for r in map(tuple, resources.feature_rows(spark.createDataFrame(rows, EVENTS), countries, ["vp", "prefix"], ["o"]).collect())}
    assert got["asn", "1", 0] == (2, 0, 2, 512, 0) and got["asn", "2", 0] == (1, 0, 1, 256, 0)
    assert got["country", "X", 0] == (3, 0, 2, 512, 0) == got["collector", "all", 0]
    assert got["asn", "1", 1] == (1, 0, 2, 512, 2)
    assert got["asn", "1", 2] == (0, 1, 0, 0, 2) and got["country", "X", 2] == (0, 1, 1, 256, 2)
    assert got["asn", "1", 3] == (1, 0, 1, 256, 2) and ("asn", "2", 3) not in got


def test_months_are_utc_in_every_session(spark, tmp_path):
    edge = 1_709_251_200  # 2024-03-01T00:00:00Z
    df = spark.createDataFrame([(k, edge + s) for k, s in enumerate((-7200, -1, 0, 1, 30_000, 86_400))], "k int, at bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        sinks.write_monthly(df, str(tmp_path / "m"), "at")
        for zone in ("Asia/Shanghai", "America/Los_Angeles", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows_of(sinks.read_months(spark, str(tmp_path / "m"), "at", edge - 7200, edge + 86_400).select("k")) == [(k,) for k in range(6)]
            assert rows_of(sinks.read_months(spark, str(tmp_path / "m"), "at", edge, edge).select("k")) == [(2,)]
            assert rows_of(df.select(sinks.utc_month(F.col("at")))) == [("202402",), ("202402",), *[("202403",)] * 4]
        sinks.write_monthly(df.filter("k = 5"), str(tmp_path / "m"), "at")
        assert rows_of(sinks.read_months(spark, str(tmp_path / "m"), "at", 0, 2 * edge).select("k")) == [(0,), (1,), (5,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_merges_replace_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(k, 1, f"a{k}") for k in range(100)], "k int, version int, x string")
    assert sinks.merge_buckets(path, first, ["k"], lambda held, rows: sinks.upsert(held, rows, ["k"], "version"), 16) == 16
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    second = spark.createDataFrame([(7, 2, "new"), (7, 1, "old"), (500, 1, "more")], "k int, version int, x string")
    assert sinks.merge_buckets(path, second, ["k"], lambda held, rows: sinks.upsert(held, rows, ["k"], "version"), 16) <= 2
    kept = [p for p, t in stamp.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len(kept) >= 14
    table = sinks.read_buckets(spark, path)
    assert table.count() == 101 and rows_of(table.filter("k IN (7, 8, 500)"), "k", "x") == [(500, "more"), (7, "new"), (8, "a8")]
    assert sinks.merge_buckets(path, second.limit(0), ["k"], lambda held, rows: rows) == 0


def test_one_country_is_replaced(spark, tmp_path):
    path = str(tmp_path / "edges")
    sinks.replace_part(path, spark.createDataFrame([("A", 1, 2), ("A", 2, 3), ("B", 4, 5)], "country string, low int, high int"), ["country"])
    sinks.replace_part(path, spark.createDataFrame([("A", 8, 9)], "country string, low int, high int"), ["country"])
    assert rows_of(spark.read.parquet(path).select("country", "low", "high")) == [("A", 8, 9), ("B", 4, 5)]


