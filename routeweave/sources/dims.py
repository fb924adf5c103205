"""Entity dimensions: first row wins, list-valued relations, and rows accepted or quarantined with reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relation names of the dictionary and their codes.
RELATION_CODES = {"provider": -1, "customer": 1, "peer": 0, "peers": 0, "sibling": 2}


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def relation_edges(df: DataFrame, key: str, relations: str) -> DataFrame:
    """One row for each target of a JSON text ``{"provider": ["1", …], …}``: (asn, relation, target, code, flag)."""
    parsed = df.select(F.col(key).alias("asn"), F.explode(F.from_json(relations, "map<string,array<string>>")).alias("relation", "targets"))
    rows = parsed.select("asn", "relation", F.explode("targets").alias("raw"))
    codes = F.create_map(*[F.lit(x) for pair in RELATION_CODES.items() for x in pair])
    target = F.col("raw").try_cast("bigint")
    flag = F.when(target.isNull(), "bad_target").when(codes[F.col("relation")].isNull(), "unknown_relation").when(F.col("relation") == "peers", "ambiguous_relation_name")
    return rows.select("asn", "relation", target.alias("target"), codes[F.col("relation")].alias("code"), flag.alias("flag"))


def screened(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a row is quarantined with the names of all rules that are true for it."""
    flags = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    judged = df.withColumn("quality_flags", flags)
    return judged.filter(F.size("quality_flags") == 0).drop("quality_flags"), judged.filter(F.size("quality_flags") > 0)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or plain, by a given schema."""
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV with a header that must name the required columns."""
    header = spark.read.option("header", "true").csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)
