"""Tests of the round's finding on the pipeline: the Jaccard stage's growth and what its plans cost the driver."""

import random

import numpy as np
from pyspark.sql import functions as F

from routeweave.llm import graph
from routeweave.llm import jaccard_join as J
from routeweave.llm.graph import connected_components


def long_texts() -> dict[int, str]:
    random.seed(3)
    words = [f"w{k}" for k in range(3000)]
    texts = {k: random.choices(words, k=6000 + 10 * k) for k in range(8)}
    texts[8] = texts[7][:5900] + ["changed"] + texts[7][5901:]
    return {k: " ".join(t) for k, t in texts.items()}


def test_fine_bitmaps_tell_long_unrelated_sets_apart(spark):
    """Of all pairs of long texts only the near copies meet as texts; with 2048 bits for every set all pairs did."""
    docs = spark.createDataFrame(list(long_texts().items()), "doc_id bigint, text string")
    signed = J.signatures(docs, 5, 80, np.zeros(0, np.uint64)).cache()
    pairs = spark.createDataFrame([(a, b) for b in range(9) for a in range(b)], "a bigint, b bigint")
    assert [tuple(r) for r in J.finer(pairs, signed, 80).collect()] == [(7, 8)]
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs, 5, 80).collect()}
    assert got == {k: min(k, 7) for k in range(9)}


def test_bits_that_differ_never_outnumber_shingles_that_differ(spark):
    """Also where the sets stand on the two sides of a length at which bitmaps grow."""
    random.seed(5)
    for n, m in ((10, 12), (2040, 2060), (4000, 4600), (16384, 16385)):
        words = [f"x{k}" for k in range(max(n, m) + 4)]
        texts = [" ".join(words[: n + 4]), " ".join(words[: m + 4])]
        rows = J.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 5, 80, np.zeros(0, np.uint64)).collect()
        x, y = (bytes(r["fine"]) for r in sorted(rows, key=lambda r: r["doc_id"]))
        assert [r["n_shingles"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [n, m]
        assert J.differing(x, y) == J.differing(y, x) <= abs(n - m)
        assert J.differing(x, y) % 2 == (m - n) % 2


def stages(spark, name: str, work) -> int:
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name))


def test_few_links_are_worked_on_without_shuffles(spark):
    """Rounds of components over few links are one partition each, so that no exchange keeps a thread of the driver."""
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = []
    n = stages(spark, "components", lambda: out.append(connected_components(links)))
    assert {r["component"] for r in out[0].collect()} == {0}
    assert out[0].count() == 41
    assert n <= 45


def test_many_links_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_PARTITION", 0)
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (7, 9), (5, 5)], "a bigint, b bigint")
    assert dict(map(tuple, connected_components(links).collect())) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_ids_that_no_rows_repeat_add_no_joins(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "d"), (None, "d")], "doc_id bigint, text string")
    repeated, same = J.one_of_each_id(docs)
    assert repeated is None and same is docs
    repeated, single = J.one_of_each_id(docs.union(docs.filter("doc_id = 1").withColumn("text", F.lit("b b"))))
    assert [r["doc_id"] for r in repeated.collect()] == [1]
    assert sorted((str(r["doc_id"]), r["text"]) for r in single.collect()) == [("1", "b b"), ("2", "c"), ("None", "d"), ("None", "d")]
