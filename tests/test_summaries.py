"""Episode records, country summaries, AS lists, key facts, mappings and probes on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from routeweave.functions.scalars import normalize_asn
from routeweave.operators import coverage, summaries

from .test_impact import population


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def members(spark):
    states, cohorts, origins = population(spark)
    held, _ = coverage.cohort(states, cohorts)
    return states, held, origins, cohorts


def test_episode_records(spark):
    """Prefix a of AS 1 is lost in slots 3 and 4, b from 3 on; c of AS 2 from 6 on."""
    _, held, origins, _ = members(spark)
    episodes = spark.createDataFrame([("x", "e", 3, 4, 5), ("y", "e", 4, 4, 4), ("z", "e", 1, 2, 2)], "episode string, event string, onset bigint, peak bigint, last bigint")
    got = summaries.episode_as_records(coverage.prefix_classes(held), origins, episodes)
    columns = ["episode", "asn", "fixed_prefixes", "trigger_prefixes", "peak_prefixes", "cumulative_prefixes", "end_prefixes", "first_damaged", "last_damaged", "recovered_from", "end_member"]
    assert rows_of(got, *columns) == [
        ("x", 1, 2, 2, 2, 2, 1, 3, 5, None, True), ("x", 2, 1, 0, 0, 0, 0, None, None, None, False), ("y", 1, 2, 2, 2, 2, 2, 4, 4, None, True), ("y", 2, 1, 0, 0, 0, 0, None, None, None, False),
        ("z", 1, 2, 0, 0, 0, 0, None, None, None, False), ("z", 2, 1, 0, 0, 0, 0, None, None, None, False),
    ]
    one = spark.createDataFrame([("w", "e", 3, 3, 8)], "episode string, event string, onset bigint, peak bigint, last bigint")
    only_a = origins.filter("prefix <> 'b'")
    got = summaries.episode_as_records(coverage.prefix_classes(held), only_a, one)
    assert rows_of(got.filter("asn = 1"), "first_damaged", "last_damaged", "recovered_from") == [(3, 4, 5)]


def test_country_summaries(spark):
    states, held, origins, cohorts = members(spark)
    got = {r["slot"]: r for r in summaries.country_summaries(states, held, origins, cohorts).collect()}
    assert [got[s]["visible"] for s in range(1, 9)] == [4, 3, 1, 1, 2, 1, 1, 1] and {got[s]["baseline"] for s in got} == {4}
    assert [got[s]["current"] for s in range(1, 9)] == [4, 4, 2, 3, 4, 2, 3, 3]  # c from a second direction, and the new prefix
    assert [got[s]["affected_asns"] for s in range(1, 9)] == [0, 1, 1, 1, 1, 2, 2, 2]
    assert [got[s]["invisible_asns"] for s in range(1, 9)] == [0, 0, 1, 1, 0, 1, 1, 1] and got[3]["visible_ratio"] == 0.25


def test_lists_of_ases(spark):
    _, held, origins, cohorts = members(spark)
    rows = summaries.asn_overview(coverage.prefix_classes(held), origins, cohorts).cache()
    got = {r["asn"]: r for r in rows.collect()}
    assert (got[1]["baseline"], got[1]["families"], got[1]["slots_fully_visible"], got[1]["slots_partially_visible"], got[1]["slots_fully_invisible"], got[1]["longest_fully_invisible"], got[1]["longest_partially_visible"]) == (3, [4], 1, 5, 2, 2, 4)
    assert (got[2]["baseline"], got[2]["slots_fully_visible"], got[2]["longest_fully_visible"], got[2]["slots_fully_invisible"]) == (1, 5, 5, 3)
    names = lambda **k: [r["asn"] for r in summaries.filter_ases(rows, **k).orderBy("asn").collect()]
    assert names() == [1, 2] and names(query=" AS2") == [2] and names(family="dual") == [] and names(family="ipv4", state="partial") == [1] and names(state="invisible") == [1, 2]
    order = lambda sort: [r["asn"] for r in rows.orderBy(*summaries.as_order(sort)).collect()]
    assert order("invisible") == [2, 1] and order("partial") == [1, 2] and order("baseline") == [1, 2] and order("asn") == [1, 2]


@pytest.mark.parametrize(("number", "size", "want"), [(1, 3, ([0, 1, 2], 1, 4)), (4, 3, ([9], 4, 4)), (99, 3, ([9], 4, 4)), (0, 500, (list(range(10)), 1, 1)), (2, 0, ([1], 2, 10))])
def test_pages(spark, number, size, want):
    got = summaries.page(spark.range(10), [F.asc("id")], number, size).orderBy("position").collect()
    assert ([r["id"] for r in got], got[0]["page"], got[0]["pages"]) == want and {r["total"] for r in got} == {10}
    assert summaries.page(spark.range(0), [F.asc("id")]).count() == 0


def test_downstream_rows(spark):
    pairs = spark.createDataFrame([(1, 12, 0), (1, 3, 5), (4, 1, 2)], "affected int, downstream int, slots int")
    assert rows_of(summaries.downstream_rows(pairs, scope="concurrent"), "affected", "downstream") == [(1, 3), (4, 1)]
    assert rows_of(summaries.downstream_rows(pairs, affected=1, query="as12"), "affected", "downstream") == [(1, 12)]


def test_key_facts(spark):
    rows = [("s", 1, 100, 5), ("s", 2, None, 9), ("s", 3, 60, 7), ("s", 4, 40, 7), ("s", 5, 40, None), ("s", 6, 70, 1), ("t", 1, 5, 0), ("u", 1, None, None)]
    got = {r["subject"]: r for r in summaries.key_facts(spark.createDataFrame(rows, "subject string, slot int, value int, hit int"), ["hit"]).collect()}
    s = got["s"]
    assert (s["start_value"], s["end_value"], s["lowest_slot"], s["lowest_value"], s["drop_slot"], s["largest_drop"]) == (100, 70, 4, 40, 3, 40)
    assert (s["lost"], s["lost_ratio"], s["recovered"], s["recovered_share"], s["end_gap"], s["hit_peak"], s["hit_peak_slot"]) == (60, 0.6, 30, 0.5, 30, 7, 3)
    t = got["t"]
    assert (t["lost"], t["recovered_share"], t["drop_slot"], t["end_gap"]) == (0, None, None, 0) and "u" not in got


def test_incident_mappings(spark):
    incidents = spark.createDataFrame([("i",), ("j",), ("k",), ("i",)], "incident string")
    mappings = spark.createDataFrame([("i", 2, "overlaps", False), ("i", 1, "contains", False), ("j", 3, "overlaps", True), ("k", 4, "no_correspondence", False), ("x", 5, "overlaps", False)], "incident string, episode int, relation string, causal boolean")
    assert rows_of(summaries.incident_mappings(incidents, mappings)) == [("i", [1, 2], "contains,overlaps"), ("j", [], "no_correspondence"), ("k", [], "no_correspondence")]


def test_probe(spark):
    rows = [("AS1", "['2', '3']"), ("AS1", None), ("", "["), (None, None), ("bad", "["), ("AS2", "[1"), ("3", "['x', '4']")]
    df = spark.createDataFrame(rows, "asn string, peers string")
    got = summaries.probe_table(df, F.col("asn"), normalize_asn(F.col("asn")).isNotNull(), ["peers"], ["peers"]).first().asDict()
    assert got == {"rows": 7, "valid_keys": 3, "empty_keys": 2, "invalid_keys": 1, "repeated_keys": 1, "unsafe_lists": 1, "bad_targets": 1}
    assert summaries.probe_table(df.limit(0), F.col("asn"), F.lit(True)).first()["rows"] == 0


def test_coordinates(spark):
    rows, places = spark.createDataFrame([("A", 1), ("B", 2)], "country string, n int"), spark.createDataFrame([("A", 1.5, 2.5)], "country string, lat double, lon double")
    assert rows_of(summaries.with_coordinates(rows, places, "country")) == [("A", 1, 1.5, 2.5), ("B", 2, None, None)]
