"""Operator 3: line dedup by levelled sorted runs of line hashes.

Documents arrive in batches. A batch's keys (128-bit hashes of normalised lines) are counted with map-side combine and
merge-anti-joined with every stored run: keys that no run holds become the batch's own run, the others become counts to
add. A run is a bucketed table with one file for each bucket, sorted by hash, so that a batch is shuffled once and
merged with each run as it lies, without sorting the run again (Spark plans a sort only where a skewed batch left a
bucket with several files). When a level holds ``fanout`` runs they are compacted into one run of the next level, so the
number of runs to merge with stays logarithmic; compacted runs are deleted, and all of them at the end. The runs and the
added counts give, for each key, in how many documents it stands and the largest doc_id. Lines of dropped keys are found
by a join on the key; a document's positions to drop are subtracted from all of its positions, in time linear in its
lines.

Native: DataFrame functions only. No group is collected: a very common line is one row after map-side combine, and the
join of lines with dropped keys is a sort-merge join that adaptive execution can split.

Defined cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` always stay; a very
long text is one row and its lines are sorted within it; rows that repeat a doc_id are documents of their own, so all
rows with the largest doc_id keep their lines; a null doc_id is the smallest; an empty table yields no rows; extra
columns are carried through; when a batch fails, its error is raised after all runs are deleted.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, let, scratch_dir, shuffle_partitions, stored

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
KEY = ["h1", "h2"]
#: Spark trusts the order inside a bucket of one file only under this setting.
_ORDERED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


@contextlib.contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside read a bucket's one sorted file as sorted."""
    before = spark.conf.get(_ORDERED_BUCKETS)
    spark.conf.set(_ORDERED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED_BUCKETS, before)


class LineRuns:
    """The levelled runs: rows (h1, h2, n_docs, max_doc), each key in one run; ``added`` has counts for keys that runs hold."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.added = spark, fanout, []
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.names: set[str] = set()
        self.root, self.buckets = scratch_dir(spark), shuffle_partitions(spark)

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, keys: DataFrame) -> tuple[str, DataFrame]:
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.add(name)
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name, self.spark.table(name)

    def _drop(self, level: list[tuple[str, DataFrame | None]]) -> None:
        for name, _ in level:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def drop(self) -> None:
        """Delete all runs and counts."""
        self._drop([(name, None) for name in self.names])
        self.levels, self.added = [[]], []
        discard(self.spark, self.root)

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_: object) -> None:
        """Also when a batch fails: no run stays in the catalog."""
        self.drop()

    def add(self, lines: DataFrame) -> DataFrame:
        """Take one batch of (doc_id, h1, h2), each document's key once; the run of keys that are new is returned."""
        keys = lines.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        fresh = keys
        for run in self.runs:
            fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
        name, own = self._write(fresh)
        if self.runs:
            self.added.append(stored(keys.join(own.hint("merge"), KEY, "left_anti"), f"{self.root}/added_{uuid.uuid4().hex}"))
        self.levels[0].append((name, own))
        self._compact()
        return own

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                union = level[0][1]
                for _, run in level[1:]:
                    union = union.unionByName(run)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(union.repartition(self.buckets, *KEY)))
                self._drop(level)
                self.levels[k] = []

    def totals(self, min_docs: int) -> DataFrame:
        """Keys of at least ``min_docs`` documents with the largest doc_id of each."""
        added = None
        for x in self.added:
            added = x if added is None else added.unionByName(x)
        found = []
        if added is not None:
            added = added.groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("later"))
        for run in self.runs:
            if added is None:
                found.append(run)
            else:
                both = run.join(added, KEY, "left")
                found.append(both.select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "later").alias("max_doc")))
        union = found[0]
        for x in found[1:]:
            union = union.unionByName(x)
        return union.filter(F.col("n_docs") >= min_docs)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, k, pos, first, h1, h2) of every line with a long key; k: hash of the text, first: the key's first line in it."""
    placed = F.filter(F.transform(split_lines(F.col("text")), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos"))), lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.sort_array(F.transform(placed, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("line"), x["key"]).alias("h2"), x["pos"].alias("pos"))))

    def marked(x: Column, before: Column) -> Column:
        again = F.coalesce((x["h1"] == before["h1"]) & (x["h2"] == before["h2"]), F.lit(False))
        return F.struct(x["pos"].alias("pos"), (~again).alias("first"), x["h1"].alias("h1"), x["h2"].alias("h2"))

    rows = let(hashed, lambda s: F.transform(s, lambda x, i: marked(x, F.get(s, i - 1))))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("k"), F.explode(rows).alias("x")).select("doc_id", "k", "x.*")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with its lines left in ``text``, and n_lines, n_dropped. Lines of a key found in at least ``min_docs`` documents stay only in the largest doc_id."""
    spark = docs.sparkSession
    rows = line_rows(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id", "k"), F.lit(batches)).cast("int"))
    held = [scratch_dir(spark), scratch_dir(spark)]
    lines = stored(rows, held[0], partition_by=("batch",))
    with LineRuns(spark, fanout) as runs, ordered_buckets(spark):
        for b in range(batches):
            runs.add(lines.filter((F.col("batch") == b) & F.col("first")).select("doc_id", *KEY))
        dropped = stored(runs.totals(min_docs).select(*KEY, "max_doc"), held[1])
    hits = lines.join(dropped, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    per_doc = stored(hits.groupBy(F.col("doc_id").alias("__hit"), F.col("k").alias("__hit_k")).agg(F.collect_set("pos").alias("__drop")))
    for path in held:  # what follows needs the places to drop alone
        discard(spark, path)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__hit_k"))
    joined = docs.join(per_doc.hint("merge"), same, "left")  # by sorting at every size: disk then grows with the input, not by leaps
    n_dropped = F.coalesce(F.size("__drop"), F.lit(0))

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.struct(F.size(lines).cast("bigint").alias("n"), F.when(n_dropped == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).alias("text"))

    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    out = joined.select(*names, let(split_lines(F.col("text")), kept).alias("__kept"), n_dropped.cast("bigint").alias("n_dropped"))
    return out.select(*names, "__kept.text", F.col("__kept.n").alias("n_lines"), "n_dropped")
