"""The pipeline's stages one by one against brute force on a small table, and its run as a whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from routeweave.llm import mixing

from .test_operators import brute_components, brute_lines, check_packing


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.withColumn("lang", F.coalesce("lang", F.lit("en"))).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_language_stage_drops_only_documents_it_rejects(steps):
    before, after = dict(pairs(steps[0])), dict(pairs(steps[1]))
    assert set(before) - set(after) >= {4, 5, 6}  # null, empty, blank
    assert {1, 2, 3, 9, 10, 12, 13, 14} <= set(after)


def test_line_stage(steps):
    kept = {i: text for i, _, dropped, text in brute_lines(pairs(steps[1])) if dropped == 0 or text.strip()}
    assert dict(pairs(steps[2])) == kept


def test_jaccard_stage(steps):
    groups = brute_components(pairs(steps[2]), P.SHINGLE_WORDS, P.SIMILAR_PERCENT)
    assert sorted(i for i, _ in pairs(steps[3])) == sorted(i for i, _, c in groups if i == c)


def test_mixing_stage(steps):
    judged = mixing.mix(steps[3]).filter("sampled").select("doc_id")
    assert sorted(r["doc_id"] for r in judged.collect()) == sorted(i for i, _ in pairs(steps[4]))


def test_packing_stage_and_run(spark, steps, sf_dir):
    check_packing(pairs(steps[4]), steps[5].collect())
    check_packing(pairs(steps[4]), P.run(spark, sf_dir).collect())


def test_run_on_odd_rows(spark, rows, tmp_path):
    """Null ids, repeated rows and ids, ties, extra columns whose names the operators use."""
    some = [(i, t, lang, source) for i, t, lang, source, _ in rows if len(t or "") < 5000]
    odd = some + [(1, some[0][1], "en", "src0"), (1, "other words under one id " * 5, "en", None), (None, some[8][1], None, "src1"), (None, None, None, None), (99, some[8][1], "de", "src1")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("bigint"))
    df.withColumns({c: F.lit(c) for c in ("id", "k", "rest", "topic", "tokens", "component_id", "batch")}).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = P.run(spark, str(tmp_path)).collect()
    whole = [r for r in pieces if r["start"] == 0]
    ids = [r["doc_id"] for r in whole if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in odd}
    assert all(sum(len(p["ids"]) // 4 for p in pieces if p["doc_id"] == r["doc_id"]) == r["doc_tokens"] for r in whole if r["doc_id"] is not None)


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns
