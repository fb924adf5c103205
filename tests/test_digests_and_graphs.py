"""Digest trees, IPv6 ancestors, capped subgraphs and waves."""

import random

import pytest
from pyspark.sql import functions as F

from routeweave.functions import prefixes
from routeweave.operators import country, digests, graph, subprefix


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


ROW = "k int, a string, b double"


def test_trees_find_the_sections_that_differ(spark):
    rows = [(k, None if k % 5 == 0 else f"x{k}", k / 2) for k in range(500)]
    changed = [(k, "y" if k == 77 else a, b) for k, a, b in rows if k != 123] + [(900, "new", 1.0)]
    a, b = (spark.createDataFrame(x, ROW).repartition(3) for x in (rows, changed))
    trees = [digests.section_tree(x, ["k"], ["k", "a", "b"]) for x in (a, b)]
    found = digests.tree_difference(*trees)
    leaves = values(found.filter("level = 3"), "node")
    names = spark.createDataFrame([(77,), (123,), (900,)], "k int").select(digests.section(["k"]).alias("s")).collect()
    assert {n for (n,) in leaves} == {r["s"] for r in names}
    root = found.filter("level = 0").first()
    assert (root["node"], root["rows_a"], root["rows_b"], root["status"]) == ("", 500, 500, "differs")
    assert digests.tree_difference(trees[0], digests.section_tree(a.repartition(7), ["k"], ["k", "a", "b"])).count() == 0
    empty = digests.section_tree(a.limit(0), ["k"], ["k", "a", "b"])
    assert empty.count() == 0 and set(values(digests.tree_difference(empty, trees[0]), "status")) == {("only_b",)}


def test_null_and_empty_differ(spark):
    one, other = (digests.digest(spark.createDataFrame([(1, x, None)], ROW), ["k", "a", "b"]).first() for x in (None, ""))
    assert one["n_rows"] == other["n_rows"] == 1 and one["high"] != other["high"]


def test_only_differing_folders_are_read(spark, tmp_path):
    rows = [(k, f"x{k}", k / 2) for k in range(300)]
    for name, data in (("one", rows), ("two", [*rows[:-1], (299, "changed", 0.0), (5, "x5", 2.5)])):
        digests.publish(spark.createDataFrame(data, ROW), str(tmp_path / name), ["k"], ["k", "a", "b"])
    got = digests.published_difference(spark, str(tmp_path / "one"), str(tmp_path / "two"), ["k", "a", "b"])
    assert values(got) == sorted([(299, "x299", 149.5, "only_a"), (299, "changed", 0.0, "only_b"), (5, "x5", 2.5, "only_b")], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [section" in plan or "PartitionFilters: [cast(section" in plan


def test_reconciliation(spark):
    a = spark.createDataFrame([(1, "p", "x", 10), (2, "q", "y", 20)], "vp int, prefix string, path string, at int")
    same = a.withColumn("at", F.lit(99))
    report, rows = digests.reconcile_states(a, same, ["vp", "prefix"], ["path"])
    assert report.first().asDict() == {"sections": 2, "rows_anchor": 2, "rows_replayed": 2, "differing": 0, "status": "consistent"} and rows.count() == 0
    report, rows = digests.reconcile_states(a, same.filter("vp = 1"), ["vp", "prefix"], ["path"])
    assert (report.first()["status"], report.first()["differing"]) == ("mismatch", 1) and values(rows) == [(2, "q", "y", "only_a")]
    report, rows = digests.reconcile_states(a.limit(0), a.limit(0), ["vp", "prefix"], ["path"])
    assert report.first()["status"] == "consistent" and report.first()["rows_anchor"] == 0


def test_row_difference_counts(spark):
    a, b = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert values(digests.row_difference(a, b)) == [(1, "only_a"), (1, "only_a"), (2, "only_a"), (3, "only_b")]


@pytest.mark.parametrize("length", [0, 1, 29, 63, 64, 65, 96, 127, 128])
def test_v6_cut(spark, length):
    import ipaddress

    address = ipaddress.ip_address("fedc:ba98:7654:3210:fedc:ba98:7654:3210")
    want = int(ipaddress.ip_network((int(address), length), strict=False).network_address)
    df = spark.createDataFrame([(f"{address}/128",)], "p string").withColumn("w", prefixes.v6_words(prefixes.parse_cidr("p")))
    got = df.select(prefixes.v6_cut(F.col("w"), F.lit(length)).alias("x")).first()["x"]
    assert (got["hi"] % (1 << 64)) << 64 | got["lo"] % (1 << 64) == want


def test_v6_sub_prefixes(spark):
    rows = [("2001:db8::/44", 1), ("2001:db8::/47", 2), ("2001:db8::/48", 2), ("2001:db8:1::/48", 3), ("2001:db8:4::/46", 1), ("2001:db8::8000:0:0:0/66", 9), ("2001:db8::/64", 2), ("::/0", 7), ("2001:db8:2::/49", 4), ("10.0.0.0/24", 5)]
    df = spark.createDataFrame(rows, "p string, origin bigint").withColumn("c", prefixes.parse_cidr("p"))
    routes = df.select(prefixes.v6_words(F.col("c")).alias("network"), F.col("c.plen").alias("length"), "origin").filter("network IS NOT NULL")
    got = {(r["length"], r["new_origins"][0] if r["new_origins"] else None): (r["parent_length"], r["reason"]) for r in subprefix.sub_prefix_states_v6(routes).collect()}
    assert got == {
        (47, 2): (44, None), (48, None): (47, "same origins"), (48, 3): (47, None), (46, None): (44, "same origins"), (66, 9): (64, None), (64, None): (48, "prefix length difference is too large"), (49, 4): (44, "prefix length difference is too large"),
    }


EDGES = [(1, 2, 5), (1, 3, 9), (2, 4, 1), (3, 4, 7), (3, 5, 7), (5, 6, 2), (7, 8, 3)]


def subgraph(spark, seeds, hops, **caps):
    edges = spark.createDataFrame(EDGES, "low bigint, high bigint, n_paths bigint")
    return values(graph.capped_subgraph(edges, spark.createDataFrame([(s,) for s in seeds], "node bigint"), hops, **caps), "low", "high", "hop")


def brute_subgraph(seeds, hops, max_nodes=None, max_edges=None):
    reached, frontier, taken = set(seeds), set(seeds), {}
    for k in range(1, hops + 1):
        following, full = set(), False
        for low, high, _ in sorted((e for e in EDGES if {e[0], e[1]} & frontier and e[:2] not in taken), key=lambda e: (-e[2], e[0], e[1])):
            taken[low, high] = k
            full = max_edges is not None and len(taken) >= max_edges
            if not full:
                following |= {low, high} - reached
                full = max_nodes is not None and len(reached | following) >= max_nodes
            if full:
                break
        reached |= following
        frontier = following
        if full:
            break
    return sorted(((*e, k) for e, k in taken.items()), key=repr)


@pytest.mark.parametrize("caps", [{}, {"max_edges": 1}, {"max_edges": 3}, {"max_nodes": 3}, {"max_nodes": 4, "max_edges": 9}, {"max_nodes": 99, "max_edges": 4}])
def test_capped_subgraph(spark, caps):
    assert subgraph(spark, [1], 3, **caps) == brute_subgraph([1], 3, **caps)


def slow_waves(x, floor, confirm):
    """By the rule: after the highest value so far, its least follower, then the first confirmed rise above that begins a wave."""
    starts = [0]
    k = 1
    while k < len(x):
        begin = starts[-1]
        peak = max(range(begin, k), key=lambda j: (x[j], j))
        if x[k] < x[peak] and k > peak + 1:
            low = min(x[peak + 1 : k])
            held = x[k : k + confirm]
            if len(held) == confirm and x[k] >= low and all(v >= low + floor for v in held):
                starts.append(k)
        k += 1
    return starts


@pytest.mark.parametrize("seed", range(4))
def test_waves_by_the_rule(spark, seed):
    draw = random.Random(seed)
    x = [round(draw.random(), 2) for _ in range(60)]
    df = spark.createDataFrame([("e", k, v) for k, v in enumerate(x)], "k string, slot bigint, v double")
    got = country.waves(df, ["k"], "slot", "v", 0.2, 2).orderBy("ordinal").collect()
    starts = slow_waves(x, 0.2, 2)
    assert [r["onset"] for r in got] == starts and len(starts) > 2
    assert [r["end"] for r in got] == [*(s - 1 for s in starts[1:]), 59]
    assert all(x[r["peak"]] == max(x[r["onset"] : r["end"] + 1]) for r in got)
