import sys
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def entry():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__

    return __spark_entry__


def rows_of(pdf):
    def text(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "-"
        if isinstance(v, float):  # a column of integers with NULLs is one of floats
            return str(int(v)) if v.is_integer() else f"{v:.9g}"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_flagship(spark, entry):
    assert entry.entry(spark).count() > 0


def test_routing_queries_equal_sql(spark, entry):
    from routeweave.plans import registry

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    differ = []
    for name, f in registry.QUERIES.items():
        got = f(spark, SF).toPandas()
        if name in registry.SQL and rows_of(got) != rows_of(db.sql(registry.SQL[name]).df()):
            differ.append(name)
    assert not differ, differ
