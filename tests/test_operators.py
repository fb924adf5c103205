"""Operators on hand-made rows with exact results."""

import pytest
from pyspark.sql import functions as F

from routeweave.functions import prefixes
from routeweave.functions import scalars as S
from routeweave.operators import cohorts, country, digests, events, features, graph, intervals, joins, quality, reports, series, state, subprefix


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def one(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("x")).first()["x"]


def test_paths(spark):
    rows = ["1 2 3", "1 2 64512", "64512 64513", "1 {2,3}", "7 7 8 8 7"]
    df = spark.createDataFrame([(r,) for r in rows], "p string").select("p", S.origin_asn(F.col("p")).alias("a"), S.origin_public(F.col("p")).alias("b"), F.array_join(S.collapse_prepends(F.split("p", " ")), " ").alias("c"))
    assert {r["p"]: (r["a"], r["b"], r["c"]) for r in df.collect()} == {
        "1 2 3": ("3", "3", "1 2 3"), "1 2 64512": ("2", "2", "1 2 64512"), "64512 64513": ("64513", None, "64512 64513"), "1 {2,3}": ("{2,3}", None, "1 {2,3}"), "7 7 8 8 7": ("7", "7", "7 8 7"),
    }


def test_segments(spark):
    schema = "k int, s array<struct<segment_type:string,asns:array<bigint>>>"
    rows = [(1, [("as_sequence", [1, 2])]), (2, [("as_sequence", [1]), ("as_set", [5, 4])]), (3, []), (4, [("as_confed_sequence", [9])]), (5, None)]
    df = spark.createDataFrame(rows, schema).select("k", S.origin_of_segments(F.col("s")).alias("o"), S.path_length(F.col("s")).alias("n"), S.path_text(F.col("s")).alias("t"))
    got = {r["k"]: (r["o"]["state"], r["o"]["origins"], r["n"], r["t"]) for r in df.collect()}
    assert got == {1: ("resolved", [2], 2, "1 2"), 2: ("conflict", [4, 5], 2, "1 {5,4}"), 3: ("unknown", [], 0, ""), 4: ("unknown", [], 0, "9"), 5: ("unknown", [], None, None)}


def test_texts(spark):
    assert one(spark, S.duration_text(F.col("s")), s=90061) == "1 days 1 hours 1 minutes 1 seconds"
    assert one(spark, S.duration_seconds(F.col("s")), s="1 days 01:01:01") == 90061
    assert one(spark, S.duration_seconds(F.col("s")), s="soon") is None
    assert one(spark, S.normalize_asn(F.col("s")), s="as 3356") == 3356
    assert one(spark, S.literal_list(F.col("s")), s="['a', \"b\", 3]") == ["a", "b", "3"]
    assert one(spark, S.embedded_times(F.col("s")), s="x 2026-02-27 08:05:00 y 2026-02-27T09:00:00") == ["2026-02-27 08:05:00", "2026-02-27T09:00:00"]
    assert one(spark, S.mentions_asn(F.col("s"), 3356), s="AS53356 and 33560") is False
    assert one(spark, S.query_kind(F.col("s")), s="rrc25") == "collector"
    assert one(spark, S.parse_locator(F.col("s")), s="hijack/2026-02-27 08:05:00/p/12/rrc25")["event_id"] == 12
    assert one(spark, S.parse_locator(F.col("s")), s="a/b")["error"] == "part_count"
    assert one(spark, S.combined_class(F.array(F.lit("visible"), F.lit("invisible")), 2)) == "partially_visible"
    assert one(spark, S.slot_before(F.col("s")), s=600) == 300 and one(spark, S.slot_at_or_after(F.col("s")), s=601) == 900


@pytest.mark.parametrize(("given", "blocks"), [(["10.0.0.0/24", "10.0.0.0/23", "10.0.1.0/24"], 2), (["10.0.0.0/25", "10.0.0.128/25", "0.0.0.0/0"], 1), (["10.0.0.0/8"], 65536)])
def test_blocks(spark, given, blocks):
    df = spark.createDataFrame([("k", p) for p in given], "k string, p string")
    assert values(intervals.v4_blocks(df, ["k"], "p")) == [("k", blocks)]


def test_prefix_text(spark):
    df = spark.createDataFrame([("10.1.2.3/23",), ("2001:db8:0::1/32",), ("300.1.1.1/8",), (None,)], "p string")
    got = {r["p"]: (r["c"]["prefix"], r["c"]["afi"], r["v"]) for r in df.select("p", prefixes.parse_cidr("p").alias("c"), prefixes.v4_text(prefixes.v4_network(F.col("p")), prefixes.v4_length(F.col("p"))).alias("v")).collect()}
    assert got == {"10.1.2.3/23": ("10.1.2.0/23", 4, "10.1.2.0/23"), "2001:db8:0::1/32": ("2001:db8::/32", 6, None), "300.1.1.1/8": (None, None, None), None: (None, None, None)}
    prefixes.register(spark)
    assert [r["length"] for r in spark.sql("SELECT * FROM prefix_ancestors('10.0.0.0/4')").collect()] == [3, 2, 1]


def test_replay_and_intervals(spark):
    rows = [("a", 1, 1, "announce", 10), ("a", 5, 2, "withdraw", None), ("b", 2, 3, "announce", 20), ("b", 3, 4, "announce", 30), ("a", 5, 5, "announce", 11)]
    df = spark.createDataFrame(rows, "k string, t bigint, n bigint, action string, origin bigint").repartition(3)
    assert values(state.replay(df, ["k"], ["t", "n"]), "k", "origin") == [("a", 11), ("b", 30)]
    spans = state.visibility(df, ["k"], ["t", "n"], "t", ["origin"])
    assert sorted(map(str, (tuple(r) for r in spans.collect()))) == sorted(map(str, [("a", 10, 1, 5), ("a", 11, 5, None), ("b", 20, 2, 3), ("b", 30, 3, None)]))
    assert state.order_conflicts(df, ["k"], ["t"]).count() == 1


def test_prefix_outage_hysteresis(spark):
    steps = [("p", vp, t, "announce") for t, vp in enumerate("abc")] + [("p", vp, 10 + t, "withdraw") for t, vp in enumerate("abc")] + [("p", "a", 20, "announce"), ("p", "b", 21, "announce")]
    df = spark.createDataFrame([(*s, i) for i, s in enumerate(steps)], "p string, vp string, t bigint, action string, n int")
    assert [tuple(r) for r in state.prefix_outages(df, ["p"], ["vp"], ["t", "n"], "t").collect()] == [("p", 12, 21, 3)]


def test_moas_and_origin_sets(spark):
    rows = [("p", "a", 1, 7), ("p", "b", 2, 7), ("p", "b", 3, 8), ("p", "a", 4, 8), ("p", "b", 5, None)]
    df = spark.createDataFrame(rows, "p string, vp string, t bigint, origin bigint")
    sets = state.origin_sets(df, ["p"], ["t"], "t", "origin", ["vp"])
    assert values(sets, "t", "origins") == [(1, 1), (3, 2), (4, 1)]
    assert [tuple(r) for r in state.moas_events(df, ["p"], ["t"], "t", "origin", ["vp"]).collect()] == [("p", 1, 3, 4, 2)]


def test_gaps(spark):
    slots = spark.createDataFrame([("k", s, 1) for s in (0, 300, 600)], "k string, slot bigint, n int")
    gaps = spark.createDataFrame([("k", 300)], "k string, gap_from bigint")
    assert [(r["n"], r["reason"]) for r in state.with_gaps(slots, gaps, ["k"], "slot", ["n"]).orderBy("slot").collect()] == [(1, None), (None, "input_gap"), (None, "input_gap")]


def test_runs_and_missing(spark):
    df = spark.createDataFrame([("k", 300 * i, s) for i, s in enumerate("aabba") if i != 2], "k string, slot bigint, s string")
    assert values(intervals.longest_runs(df, ["k"], "slot", "s"), "s", "longest", "total") == [("a", 2, 3), ("b", 1, 1)]
    assert values(intervals.missing_ranges(df, ["k"], "slot", 300)) == [("k", 600, 600, 1)]
    spans = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, None), ("k", 10, 12)], "k string, s bigint, e bigint")
    assert sorted(map(str, (tuple(r) for r in intervals.merge_intervals(spans, ["k"], "s", "e").collect()))) == ["('k', 0, 7, 2)", "('k', 9, None, 2)"]


def test_episodes(spark):
    def found(shares, damaged=None, **more):
        rows = [("k", 300 * i, v, (damaged or {}).get(i, 0.0)) for i, v in enumerate(shares) if v != "gap"]
        df = spark.createDataFrame(rows, "k string, slot bigint, r double, d double")
        return [tuple(r)[1:] for r in series.episodes(df, ["k"], "slot", "r", "d", **more).orderBy("start_slot").collect()]

    # two slots below open one at the first; six within the band close it at the first of them; 0.995 is a partial recovery
    assert found([1.0, 0.98, 1.0, 0.9, 0.8, *[0.995] * 6, *[1.0] * 6]) == [(900, 3300, 0.8, 1200, 0.0, 3300, "fully_recovered", "exact")]
    # a share of damaged ASes alone opens one, and holds it open although all is visible
    assert found([1.0] * 9, {0: 0.05, 1: 0.04, 6: 0.2}) == [(0, None, 1.0, 0, 0.2, 2400, "partially_recovered", "lower_bound")]
    # a missing share starts the counts anew, a gap ends the episode as unknown
    assert found([0.5, 0.5, 1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]) == [(0, None, 0.5, 0, 0.0, None, "recovering", "lower_bound")]
    assert found([0.5, 0.5, "gap", 0.5, 0.6, 0.6]) == [(0, None, 0.5, 0, 0.0, None, "unknown", "unknown"), (1200, None, 0.6, 1200, 0.0, None, "ongoing", "lower_bound")]


def test_outlier_band(spark):
    def bands(numbers, days=3):
        df = spark.createDataFrame([("k", 3600 * i, v) for i, v in enumerate(numbers)], "k string, t bigint, v double")
        return [(r["low"], r["high"], r["outlier"]) for r in series.outlier_band(df, ["k"], "t", "v", days).orderBy("t").collect()]

    # before the seventh sample the present one counts: one sample of 10 gives int(10 * 0.8) and int(10 * 1.2)
    assert bands([10.0, 10.0, 30.0]) == [(8, 12, False), (8, 12, False), (-9, 53, False)]
    # from the seventh on only more than five normal ones move the band
    got = bands([10.0] * 6 + [20.0, 12.0, 13.0])
    assert got[6:] == [(8, 12, True), (8, 12, False), (6, 14, False)]


def test_levels_and_exclusions(spark):
    rows = spark.createDataFrame([(True, 11, 0.0), (False, 501, 0.31), (False, 501, 0.3), (True, 10, 1.0)], "i boolean, n int, r double")
    assert [r[0] for r in rows.select(S.as_outage_level(F.col("i"), F.col("n"), F.col("r"))).collect()] == ["high", "middle", "low", "low"]
    rows = spark.createDataFrame([(100, 8), (100, 5), (99, 8), (1000, 74), (40, 4)], "n int, down int")
    assert [r[0] for r in rows.select(S.country_outage_level(F.col("n"), F.col("down"))).collect()] == ["high", "middle", "low", "middle", "low"]
    rows = spark.createDataFrame([("120.0.0.0/11", 4, 11), ("0.0.0.0/0", 4, 0), ("::/0", 6, 0), ("10.0.0.0/8", 4, 8), ("173.0.0.0/11", 4, 11)], "p string, a int, n int")
    assert [r[0] for r in rows.select(prefixes.skip_reason(F.col("p"), F.col("a"), F.col("n"))).collect()] == ["manually_excluded_prefix", "oversized_ipv4_prefix", "oversized_ipv6_prefix", None, "manually_excluded_prefix"]
    rows = spark.createDataFrame([("10.1.2.3/16",), ("10.0.0.256/24",), ("10.0.0.0/33",), ("::1/64",), (None,), ("1.2.3.4/32",)], "p string")
    assert [r[0] and tuple(r[0]) for r in rows.select(prefixes.v4_parts(F.col("p"))).collect()] == [(10 * 2**24 + 2**16, 16, 2**16), None, None, None, None, (2**24 + 2 * 2**16 + 3 * 256 + 4, 32, 1)]


def test_first_leak_of_a_prefix(spark):
    # 2 is a customer of 1 and of 3; 5 and 6 are peers although an edge calls 5 a provider of 6
    edges = spark.createDataFrame([("1", "2", -1), ("3", "2", -1), ("5", "6", -1), ("6", "5", 0), ("7", "6", -1)], "a string, b string, rel int")
    paths = [("p", 1, "9 3 2 2 1"), ("p", 2, "9 1 2 3"), ("q", 1, "9 {3,4} 2 1"), ("q", 2, "3 2 1"), ("r", 1, "9 7 6 5"), ("s", 1, "8 1 2 3 4 3 2 1")]
    known = spark.createDataFrame([("1", "2", "3", 0.2)], "first_as string, second_as string, third_as string, stability double")
    df = spark.createDataFrame(paths, "prefix string, t int, path string")
    got = state.leak_triplets(df, edges, known, "path", ["prefix"], ["t"])
    assert values(got, "prefix", "t", "from_origin", "first_as", "second_as", "third_as") == [("p", 2, 0, "3", "2", "1"), ("s", 1, 4, "3", "2", "1")]
    assert values(state.leak_triplets(df, edges, known.limit(0), "path", ["prefix"], ["t"]), "prefix", "t", "from_origin") == [("p", 1, 0), ("s", 1, 0)]


def test_shapes_and_patterns(spark):
    def series_of(numbers, n=100):
        return spark.createDataFrame([("k", 300 * i, float(v), n) for i, v in enumerate(numbers)], "k string, slot bigint, r double, n int")

    shape = lambda x: series.curve_shape(series_of(x), ["k"], "slot", "r").first()[1:]
    assert shape([1.0, 0.99, 0.9, 0.8, 0.85]) == ("STABLE→DEGRADING→RECOVERING", 3) and shape([1.0]) == ("STABLE", 1)
    pattern = lambda x, n=100: cohorts.pattern_features(series_of(x, n), ["k"], "slot", "r", "n").first()["pattern"]
    assert pattern([1.0, 0.5, 1.0], 9) == "small_denominator" and pattern([1.0, 0.99, 1.0]) == "plateau"
    assert pattern([1.0, 0.9] * 5) == "oscillation" and pattern([1.0, 0.9, 0.95, 0.8]) == "multi_wave"
    assert [pattern([0.9, 0.7, x]) for x in (0.8, 0.9, 0.95)] == ["single_wave_partial_rebound", "single_wave_return_to_window_start", "single_wave_above_window_start"]
    assert pattern([0.7, 0.9, 0.6, 0.7]) == "mixed" and pattern([1.0, 0.95, 0.9]) == "unmatched"
    assert [r["share"] for r in series.percentile_of(series_of([5, 1, 3, 3]), "r", "share").orderBy("r").collect()] == [0.25, 0.75, 0.75, 1.0]


def test_order_of_input_does_not_matter(spark):
    df = spark.createDataFrame([("k", 300 * i, float((i * 7) % 5)) for i in range(40)], "k string, slot bigint, v double")
    one_way, other = (series.key_points(d, ["k"], "slot", "v").first() for d in (df.orderBy("slot"), df.orderBy(F.desc("v"))))
    assert one_way == other


def test_joins(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (3, 2, -1)], "a bigint, b bigint, rel int")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (1, 3)], "a bigint, b bigint")
    assert values(joins.relation_of(pairs, edges)) == [(1, 2, "customer_provider"), (1, 3, "none"), (2, 1, "provider_customer"), (3, 2, "peer")]
    left, right = spark.createDataFrame([("k", 100), ("k", 500)], "k string, t bigint"), spark.createDataFrame([("k", 160), ("k", 440)], "k string, u bigint")
    assert values(joins.within(left, right, "k", "t", "u", 60)) == [("k", 100, 160), ("k", 500, 440)]
    table = spark.createDataFrame([(0, 1), (2**24, 8)], "network bigint, length int")
    addresses = spark.createDataFrame([(5,), (2**24 + 9,), (2**31 + 1,)], "address bigint")
    assert sorted(map(str, (tuple(r) for r in joins.longest_match(addresses, table, "address").collect()))) == sorted(map(str, [(5, 0, 1), (2**24 + 9, 2**24, 8), (2**31 + 1, None, None)]))
    nets = spark.createDataFrame([(1, 2**24 + 256, 24)], "id int, network bigint, length int")
    assert values(features.nearest_covering(nets, table, "id")) == [(1, 2**24, 8)]


def test_graph(spark):
    paths = spark.createDataFrame([("1 2 2 3",), ("1 64512 3",), ("4 {5,6}",), (None,)], "as_path string")
    assert values(graph.adjacency(paths)) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]
    assert values(graph.neighbourhood(graph.adjacency(paths), spark.createDataFrame([(2,)], "node bigint"), 2)) == [(1, 1), (2, 0), (3, 1)]
    assert values(graph.downstream(paths, spark.createDataFrame([(2,)], "asn bigint"))) == [(2, 3, 1)]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "", 1.0), (2, None, None)], "id int, s string, v double")
    assert values(quality.profile(df, ["s", "v"])) == [("s", 3, 1, 1, 0, 2), ("v", 3, 1, 0, 1, 2)]
    found = quality.gate(quality.violations(df, {"v": F.col("v") >= 0, "id": F.col("id") > 0}), ["v"])
    assert values(found) == [("id", 3, 0, "pass", False), ("v", 3, 1, "fail", True)]
    parts = [digests.digest(df.filter(c), ["id", "s"]).first() for c in ("id = 1", "id = 2")]
    assert tuple(map(sum, zip(*parts))) == tuple(digests.digest(df.repartition(3), ["id", "s"]).first())


def test_empty_event_series(spark):
    a, p = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5, 1.0), (1, 3, 2.0)], "k int, t int, v double")
    got = {r["k"]: [tuple(x) for x in r["series"]] for r in events.nested_series(a, p, "k", "t", "v").collect()}
    assert got == {1: [(3, 2.0), (5, 1.0)], 2: []}


def test_coverage_of_overlapping_and_odd_prefixes(spark):
    v6 = lambda *p: intervals.v6_blocks_48(spark.createDataFrame([("k", x) for x in p], "k string, p string"), ["k"], "p").first()
    assert v6("2001:db8::/47", "2001:db8:1::/48", "2001:db8:2::/48")["blocks"] == 3
    assert v6("::/0", "2001:db8::/48")["blocks"] == 1
    assert v6("2001:db8::1/64", "2001:DB8:0:5::/64", "10.0.0.0/8", "nonsense", None)["blocks"] == 1 and v6("::/0") is None
    v4 = lambda *p: intervals.v4_blocks(spark.createDataFrame([("k", x) for x in p], "k string, p string"), ["k"], "p").first()
    assert v4("10.0.0.0/24", "10.0.0.0/23", "10.0.1.0/24")["blocks"] == 2
    assert v4("0.0.0.0/0", "10.0.0.0/24")["blocks"] == 1
    assert v4("10.0.0.77/32", "10.0.0.5/30", "::1/64", "10.0.0.0/33", "10.0.3.9/22")["blocks"] == 4
    df = spark.createDataFrame([("k", x) for x in ("10.0.0.0/31", "10.0.0.1/32", "10.0.0.128/25")], "k string, p string")
    assert tuple(intervals.v4_addresses(df, ["k"], "p").first()) == ("k", 130, 130 / 256)
    given = spark.createDataFrame([(x,) for x in ("10.1.2.3/8", "2001:DB8::1/32", "1.2.3.4", "x/24")], "p string").select(prefixes.parse_cidr("p").alias("c")).select("c.prefix", "c.afi", "c.plen")
    assert [tuple(r) for r in given.collect()] == [("10.0.0.0/8", 4, 8), ("2001:db8::/32", 6, 32), ("1.2.3.4/32", 4, 32), (None, None, None)]


def test_country_cohort_and_observations(spark):
    schema = "vp int, afi int, prefix string, origin_state string, origin bigint"
    seed = [(1, 4, "a", "resolved", 10), (2, 4, "a", "resolved", 10), (1, 6, "b", "resolved", 10), (1, 4, "c", "resolved", 20), (1, 4, "d", "unknown", None), (1, 4, "e", "conflict", None), (1, 4, "f", "resolved", 30), (1, 4, "g", "resolved", 40), (1, 4, "h", "resolved", 50)]
    entries = spark.createDataFrame(seed, schema)
    members = spark.createDataFrame([(10, True), (20, True), (30, None), (40, False), (60, True)], "asn bigint, member boolean")
    assert tuple(country.cohort_quality(entries, members).first()) == (4, 1, 1, 1, 2)
    cohort = country.freeze_cohort(entries, members)
    assert values(country.cohort_sizes(cohort)) == [(10, 4, 2, 1), (10, 6, 1, 1), (20, 4, 1, 1)]
    now = spark.createDataFrame([(0, 1, 4, "a", 10), (0, 2, 4, "a", 99), (0, 1, 6, "b", 10), (0, 1, 4, "z", 60), (300, 1, 6, "b", 10), (600, 1, 4, "a", 10)], "slot bigint, vp int, afi int, prefix string, origin bigint")
    continuity = spark.createDataFrame([(0, True), (300, True), (600, False)], "slot bigint, continuous boolean")
    got = {r["slot"]: r for r in country.observations(country.member_classes(cohort, now), continuity).collect()}
    pick = lambda r: (r["fully_visible"], r["partially_visible"], r["fully_invisible"], r["only_v6"], r["affected_ratio"], r["visible_ratio"], r["route_ratio"], r["reason"])
    assert pick(got[0]) == (0, 1, 1, 0, 1.0, 0.5, 0.5, None) and pick(got[300]) == (0, 1, 1, 1, 1.0, 0.5, 0.25, None)
    assert pick(got[600]) == (*[None] * 7, "input_gap") and got[600]["baseline_asns"] == 2
    assert values(country.dynamic_members(cohort, now, members)) == [(0, 4, 1, 1)]
    seeds, later = spark.createDataFrame([(10, "a")], "asn int, p string"), spark.createDataFrame([(10, "a", 500), (20, "c", 900), (20, "c", 700)], "asn int, p string, t bigint")
    assert values(country.growing_members(seeds, later, ["asn", "p"], "t", 100)) == [(10, "a", 100), (20, "c", 700)]


def test_waves_and_trend_profile(spark):
    def found(numbers, floor=0.05):
        df = spark.createDataFrame([("e", 300 * i, v) for i, v in enumerate(numbers)], "k string, slot bigint, v double")
        return [tuple(r)[1:] for r in country.waves(df, ["k"], "slot", "v", floor).orderBy("ordinal").collect()]

    assert found([0.2, 0.5, 0.3, 0.1, 0.4, 0.4, 0.2]) == [(1, 0, 300, 900), (2, 1200, 1200, 1800)]
    assert found([0.2, 0.5, 0.3, 0.1, 0.4, 0.1]) == [(1, 0, 300, 1500)]  # one slot does not confirm
    assert found([0.2, 0.5, 0.1, 0.14, 0.14]) == [(1, 0, 300, 1200)] and found([0.2, None, 0.1]) == []
    slots = [("a", i, "observed") for i in range(3)] + [("b", 0, "missing"), ("b", 1, "observed")] + [("c", 0, "gap")]
    profile = country.trend_profile(spark.createDataFrame(slots, "k string, slot int, s string"), ["k"], "slot", "s")
    assert values(profile, "k", "expected", "observed", "status", "limitations") == [
        ("a", 3, 3, "complete", ""), ("b", 2, 1, "degraded", "non_observed_slots_present,window_start_not_observed"),
        ("c", 1, 0, "unavailable", "no_observed_slots,window_start_not_observed,window_end_not_observed"),
    ]


def test_sub_prefix_hijacks(spark):
    net = 10 * 2**24
    routes = spark.createDataFrame([(net, 16, 1), (net, 24, 2), (net + 256, 24, 1), (net + 512, 25, 3), (net + 2**16, 16, 5), (net + 2**16, 16, 6), (net + 2**16, 20, 7), (net, 8, 9), (0, 0, 1)], "network bigint, length int, origin bigint")
    states = subprefix.sub_prefix_states(routes)
    got = {(r["network"], r["length"]): (r["parent_length"], r["new_origins"], r["reason"]) for r in states.collect()}
    assert got[net, 24] == (16, [2], None) and got[net + 256, 24] == (16, [], "same origins") and got[net + 512, 25] == (16, [3], "prefix length difference is too large")
    assert got[net + 2**16, 20] == (16, [7], "parent origin as num more than 1") and got[net, 16] == (8, [1], None) and (net, 8) not in got
    nothing = spark.createDataFrame([], "network bigint, length int, origin bigint")
    pairs, asns = spark.createDataFrame([], "asn bigint, other bigint"), spark.createDataFrame([], "asn bigint")
    edges, orgs = spark.createDataFrame([(2, 1, 0)], "a bigint, b bigint, rel int"), spark.createDataFrame([(1, "x", "Same"), (9, "y", "Same")], "asn bigint, org string, org_en string")
    filtered = lambda e, p: {(r["suspect"], r["owner"]): r["filter_reason"] for r in subprefix.cleared_pairs(states, nothing, p, e, orgs, asns).collect()}
    assert filtered(edges, pairs) == {(2, 1): "as rel peer", (1, 9): "as rel same org", (5, 9): None, (6, 9): None}
    assert filtered(edges.limit(0), pairs)[2, 1] is None
    assert filtered(edges, spark.createDataFrame([(1, 2)], "asn bigint, other bigint"))[2, 1] == "policy"
    flags = spark.createDataFrame([("p", i, f) for i, f in enumerate([False, True, True, False, True])], "k string, t int, f boolean")
    assert sorted(map(str, map(tuple, subprefix.lifecycle(flags, ["k"], "t", "f").collect()))) == ["('p', 1, 3)", "('p', 4, None)"]


def test_reports(spark):
    rows = spark.createDataFrame([("1_64512",), ("2",), ("3",)], "asn string")
    names = spark.createDataFrame([(1, "", "one"), (2, "zwei", "two")], "asn int, name_local string, name_en string")
    assert values(reports.with_attributes(rows, "asn", names)) == [("1_64512", "one"), ("2", "zwei"), ("3", "")]
    staged = spark.createDataFrame([(1, '[{"v":5},{"v":6}]'), (2, "[]"), (3, "broken"), (4, None)], "k int, p string")
    assert sorted(map(str, map(tuple, reports.unnested(staged, ["k"], "p", "struct<v:int>").collect()))) == ["(1, 0, 5)", "(1, 1, 6)", "(2, None, None)", "(3, None, None)", "(4, None, None)"]
    texts = spark.createDataFrame([("Alpha", "x", "a"), ("beta", "ALPHAbet", "b"), (None, None, "a")], "s string, t string, c string")
    assert reports.text_filter(texts, ["s", "t"], "aLpHa").count() == 2 and reports.text_filter(texts, ["s", "t"], "alpha", {"c": ["b"]}).count() == 1
    states = spark.createDataFrame([("k", i, s) for i, s in enumerate("aab")] + [("n", 0, None), ("n", 1, None)], "k string, t int, s string")
    assert values(reports.state_timelines(states, ["k"], "t", "s"), "k", "timeline", "n_runs") == [("k", "a*2 b*1", 2), ("n", "2", 1)]
    spans = spark.createDataFrame([(0, 10, 10), (0, None, 3), (9, 5, 4), (0, 7, 9)], "s int, e int, c int")
    assert [r["duration_check"] for r in reports.duration_checks(spans, "s", "e", "c", 1).collect()] == ["consistent", "open", "reversed", "inconsistent"]
    closed = spark.createDataFrame([(4, 3, 1, 0.75), (4, 3, 2, 0.75), (None, 1, 1, None)], "n int, a int, b int, r double")
    assert [tuple(r)[-2:] for r in reports.closure_checks(closed, "n", ["a", "b"], {"r": (["a"], "n")}).collect()] == [("holds", "holds"), ("broken", "holds"), ("not_checked", "not_checked")]
    nets = spark.createDataFrame([(x,) for x in ("10.0.0.0/24", "10.0.0.0/23", "10.0.1.7/32", "0.0.0.0/0", "x", None)], "p string")
    assert nets.agg(reports.covered_blocks("p").alias("n")).first()["n"] == 2


def test_slot_populations(spark):
    rows = [("a", "p", 0, 20), ("a", "p", 5, None), ("a", "q", 10, 11), ("a", "q", 11, 19), ("b", "p", 30, 31)]
    df = spark.createDataFrame(rows, "s string, item string, from_at bigint, to_at bigint")
    slots = spark.createDataFrame([(0,), (10,), (20,), (40,)], "slot bigint")
    got = values(state.slot_populations(df, slots, ["s"], "item", 10), "slot", "s", "routes", "items")
    assert got == [(0, "a", 1, 1), (10, "a", 3, 2), (20, "a", 1, 1), (40, "a", 1, 1)]
    assert state.slot_populations(df.limit(0), slots, ["s"], "item", 10).count() == 0
