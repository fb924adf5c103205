"""Queries against their SQL on inputs that the given tables do not have."""

import datetime
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from routeweave.llm import line_dedup
from routeweave.operators import graph, state
from routeweave.plans import bindings, registry


def against_sql(spark, path, name, **tables):
    """The rows of query ``name`` over ``tables``, which have to be those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, rows in tables.items():
        pq.write_table(rows, path / f"{table}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    df = registry.QUERIES[name](spark, str(path))
    got = Counter(map(tuple, df.collect()))
    want = Counter(con.execute("SELECT " + ", ".join(f'"{c}"' for c in df.columns) + f" FROM ({registry.SQL[name]})").fetchall())
    assert got == want
    return got


def events(rows):
    """``rows``: (event_id, ts, user_id, event_type, value)."""
    ids, times, users, kinds, values = zip(*rows)
    return pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": list(kinds),
        "value": pa.array(values, pa.float64()), "props": ['{"k": 6}'] * len(ids),
    })


def test_anchor_in_the_last_half_second_of_a_day(spark, tmp_path):
    at = lambda day, *time: datetime.datetime(2024, 1, day, *time)
    rows = [(0, at(1, 10), 1, "click", 5.0), (1, at(1, 23, 59, 59, 700_000), 1, "signup", 0.0), (2, at(1, 23, 59, 59, 500_000), 2, "signup", 0.0), (3, at(1, 23, 59, 59, 499_999), 3, "signup", 0.0), (4, at(1, 9, 59, 59, 900_000), 3, "click", 7.0)]
    got = against_sql(spark, tmp_path, "as_of_state", events=events(rows))
    assert got[1, 1704153600, 5.0] == 1


def test_seeds_that_reach_the_cap_alone(spark, tmp_path):
    """60 suppliers are seeds: no edge is taken. 59 are: one node more is."""
    lines = pa.table({"l_orderkey": pa.array([1, 1, 2, 2], pa.int64()), "l_suppkey": pa.array([1, 900, 2, 901], pa.int64()), "l_linenumber": [1, 2, 1, 2]})
    seeds = lambda n: pa.table({"s_suppkey": pa.array(range(n), pa.int64()), "s_acctbal": [-900.0] * n})
    for n, found in ((60, 0), (61, 0), (59, 1)):
        path = tmp_path / str(n)
        path.mkdir()
        assert len(against_sql(spark, path, "capped_subgraph", supplier=seeds(n), lineitem=lines)) == found


def test_session_reports_with_event_ids_of_more_than_a_second(spark, tmp_path):
    """In the SQL's order an event id of 500000 is a second, so that a route of the second in which a session settles can come after it."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 1, "view", 0.0), (2, at(5), 2, "view", 0.0), (90, at(10), 3, "view", 0.0), (135, at(20), 4, "error", 0.0)]
    rows += [(500_001, at(620), 1, "view", 0.0), (3, at(620), 2, "view", 0.0), (500_003, at(619), 5, "view", 0.0), (1_000_035, at(700), 6, "view", 0.0), (270, at(701), 7, "view", 0.0)]
    got = against_sql(spark, tmp_path, "session_reports", events=events(rows))
    assert {r[2] for r in got} == {"lost", "up", "settled"}


def test_parts_of_paths_follow_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bindings, "LINES_A_PART", 20)
    lines = pa.table({"l_orderkey": pa.array([k // 4 for k in range(200)], pa.int64()), "l_suppkey": pa.array(range(200), pa.int64()), "l_linenumber": [k % 4 for k in range(200)]})
    pq.write_table(lines, tmp_path / "lineitem.parquet")
    found = bindings.paths(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
    assert found.select("part").distinct().count() > 5 and found.count() == 50


def test_a_subgraph_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(n):
        read.add(1)
        return n

    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(30)], "low bigint, high bigint, n_paths bigint").withColumn("n_paths", F.udf(seen, "bigint")("n_paths"))
    found = graph.capped_subgraph(edges, spark.createDataFrame([(3,)], "node bigint"), 3)
    assert sorted(map(tuple, found.select("low", "hop").collect())) == [(0, 3), (1, 2), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert read.value == 30


def test_line_dedup_plans_a_small_table_as_a_large_one(spark):
    docs = spark.createDataFrame([(k, "a line of more than twenty characters\nown " + str(k)) for k in range(9)], "doc_id bigint, text string")
    found = line_dedup.dedup_lines(docs)
    assert sorted(r["n_dropped"] for r in found.collect()) == [0] + [1] * 8
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_leaks_look_relations_up_without_listing_the_hops_first(spark):
    """The paths are read once; a triplet that any row of ``known`` calls stable is passed over."""
    read = spark.sparkContext.accumulator(0)

    def seen(path):
        read.add(1)
        return path

    paths = spark.createDataFrame([("p", 1, "9 3 2 1"), ("q", 2, "8 3 2 1")], "prefix string, t int, path string").withColumn("path", F.udf(seen, "string").asNondeterministic()("path"))
    edges = spark.createDataFrame([(a, b, -1) for a, b in (("1", "2"), ("3", "2"))], "a string, b string, rel int")
    known = spark.createDataFrame([("1", "2", "3", 0.5), ("1", "2", "3", 0.1)], "first_as string, second_as string, third_as string, stability double")
    rows = state.leak_triplets(paths, edges, known.limit(0), "path", ["prefix"], ["t"]).collect()
    assert read.value == 2 and len(rows) == 2
    assert state.leak_triplets(paths, edges, known, "path", ["prefix"], ["t"]).filter("second_as = '2'").count() == 0
