"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, language, topic) with map-side combine. The cells' token weights are raked to
the target share of each margin in turn, sweep after sweep, until all three fit to ``TOLERANCE``. The weights are scaled
until the first cell is taken whole; if that is less than ``budget`` of all tokens they are scaled to the budget
instead, cells that would need more tokens than they have are taken whole, and the others are raked again to what is
left of each margin, until no cell is over. A document's probability is its cell's calibrated rate; it is taken if a
hash of its id falls below, so the sample is the same in each run. A margin that cells cannot reach (a warning says how
far it stays off) leaves the others as near as ``sweeps`` sweeps bring them.

Native: DataFrame functions only. Sweeps are written to the shared folder, several at once; a cell table of measured small
size is one partition, whose windows need no shuffle, and a larger one is shuffled by margin. A hot source is a few cells
with a low rate; the rates go back to documents by a join on the cell whose small side Spark may broadcast after
measuring it, and which it can split otherwise.

Defined cases: null source, language or text count as the values ``(none)``, ``(none)`` and empty; documents without
words have probability 0; a very long text is counted whole; rows that repeat a doc_id share their fate (one hash), and
all count in their cells; ties need no rule, as no row is ranked; shares of values that no document has are left out and
the others scaled to 1; with no tokens at all nothing is sampled; an empty table yields no rows; extra columns are carried
through, those named like a result are replaced by it.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, stored

MARGINS = ("source", "lang", "topic")
POWER, SEED = 0.9, "mix-1"
#: How far a sweep's factors may be from 1, at the end and before cells that are over become whole.
TOLERANCE, ROUGH = 1e-12, 1e-6
#: Most sweeps of a raking that does not get there; sweeps written at once; most cells that are one partition.
SWEEPS, AT_ONCE, ONE_PARTITION = 200, 5, 100_000
#: The least expected sample, as a share of all tokens.
BUDGET = 0.75
NONE = "(none)"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^" + BLANK_CLASS[1:-1] + "]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """A text's kind by fixed rules, the first that holds: it stands for the topic that documents do not name."""
    lines = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
    symbols = F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))
    return (
        F.when(10 * symbols > tokens, "symbols")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("icense")), "license")
        .when(tokens < 50, "short")
        .when(10 * lines > tokens, "listing")
        .when(tokens > 1000, "long")
        .otherwise("prose")
    )


def target_shares(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """(margin, share) of the values that have tokens: given shares, or the present ones raised to a power; they sum to 1."""
    present = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    if isinstance(target, Mapping):
        spark = cells.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in target.items()], f"{margin} string, raw double")
        raw = present.join(given, margin).filter("raw > 0").select(margin, "raw")
    else:
        raw = present.select(margin, F.pow(F.col("tokens").cast("double"), F.lit(float(target))).alias("raw"))
    return raw.select(margin, (F.col("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0)))).alias("share"))


def filled(df: DataFrame, raw: str, most: str, total: Column) -> DataFrame:
    """``df`` with ``given``: min(``most``, c * ``raw``), c solved so that it sums to ``total``, at most the sum of ``most``.

    The sum is concave in c, so c is the largest (total - what the first rows hold) / (raw of the others), by rows in
    the order in which they reach ``most``. For tables of cells: one window over all rows.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(most) / F.col(raw), *[m for m in MARGINS if m in df.columns])
    full = F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(raw).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = F.max("__c").over(Window.partitionBy(F.lit(0)))
    out = df.withColumn("__c", (total - full) / rest)
    return out.withColumn("given", F.least(F.col(most), c * F.col(raw))).drop("__c")


def fitted(cells: DataFrame, sweeps: int, tolerance: float) -> tuple[DataFrame, float]:
    """``cells`` with ``weight`` raked to each margin's ``{margin}_rest``, and how far the factors of the last sweep were from 1."""
    columns, done, error = cells.columns, 0, float("inf")
    rest = ", ".join(c for c in columns if c != "weight")
    step = f"SELECT {rest}, weight * coalesce({{margin}}_rest / nullif(sum(weight) OVER (PARTITION BY {{margin}}), 0), 1) AS weight{{more}} FROM ({{source}})"
    while True:
        source, turns = "SELECT * FROM {cells}", min(AT_ONCE, sweeps - done)  # one statement of nested steps, analysed once
        for turn in range(turns):
            for k, margin in enumerate(MARGINS):
                before = ", before" if k else ", weight AS before"
                source = step.format(margin=margin, source=source, more=before if turn == turns - 1 else "")
        cells = stored(cells.sparkSession.sql(f"SELECT *, coalesce(abs(weight / nullif(before, 0) - 1), 0) AS error FROM ({source})", cells=cells))
        done += turns
        seen = cells.agg(F.max("error").alias("e"), F.count("*").alias("n")).first()
        last, error = error, seen["e"] or 0.0
        cells = _few(cells.select(*columns), seen["n"])
        rounded = last <= error < 1e-9  # no more than rounding is left
        if error <= tolerance or rounded or done >= sweeps:
            return cells, error


def _few(cells: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` cells, as one partition if there are at most ``ONE_PARTITION``."""
    return cells.coalesce(1) if n <= ONE_PARTITION else cells


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: tokens to take, at least ``budget`` of all, with the target margins as far as cells reach."""
    start = cells.filter("tokens > 0")
    for margin in MARGINS:
        shares = target_shares(cells, margin, targets[margin]).withColumnRenamed("share", f"{margin}_share")
        start = start.join(shares, margin)
    start = stored(start.withColumn("tokens", F.col("tokens").cast("double")))
    sums = start.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    tokens, n = sums["tokens"] or 0.0, sums["n"]
    start = _few(start, n)
    plain = start.select(*MARGINS, "tokens", *[(F.col(f"{m}_share") * tokens).alias(f"{m}_rest") for m in MARGINS], F.col("tokens").alias("weight"))
    plain, error = fitted(plain, sweeps, ROUGH)
    room = F.min(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))
    if (plain.select(room).first()[0] or 0.0) >= budget:  # the weights sum to all tokens
        plain, error = fitted(plain, sweeps, TOLERANCE)
        room = plain.select(room).first()[0]
        _report(error)
        return plain.select(*MARGINS, "tokens", F.least("tokens", F.col("weight") * room).alias("weight"))
    total, weighted = F.lit(budget * tokens), start
    for margin in MARGINS:
        values = start.groupBy(margin).agg(F.sum("tokens").alias("present"), F.max(f"{margin}_share").alias("share"))
        weighted = weighted.join(filled(values, "share", "present", total).select(margin, F.col("given").alias(f"{margin}_wanted")), margin)
    columns = [*MARGINS, "tokens", *[f"{m}_wanted" for m in MARGINS]]
    weighted = _few(stored(weighted.select(*columns, (F.col("tokens") * budget).alias("weight"), F.lit(False).alias("whole"))), n)
    tolerance = ROUGH
    while True:
        taken = F.when(F.col("whole"), F.col("tokens")).otherwise(0.0)
        left = {f"{m}_rest": F.greatest(F.col(f"{m}_wanted") - F.sum(taken).over(Window.partitionBy(m)), F.lit(0.0)) for m in MARGINS}
        free, error = fitted(weighted.withColumns(left).filter("NOT whole").drop("whole"), sweeps, tolerance)
        over = F.col("weight") > F.col("tokens") * (1 + 1e-9)
        done = not free.select(F.bool_or(over)).first()[0]
        free = free.select(*columns, F.when(over, F.col("tokens")).otherwise(F.col("weight")).alias("weight"), over.alias("whole"))
        weighted = _few(stored(weighted.filter("whole").unionByName(free)), n)
        if done and tolerance == TOLERANCE:
            break
        tolerance = TOLERANCE if done else ROUGH
    _report(error)
    return weighted.select(*MARGINS, "tokens", F.least("tokens", "weight").alias("weight"))


def _report(error: float) -> None:
    if error > 1e-6:
        warnings.warn(f"a margin stays off its target by {error:.2g} of it: the cells cannot reach all targets", stacklevel=3)


def sample_uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] | None = None, sweeps: int = SWEEPS, seed: str = SEED, budget: float = BUDGET) -> DataFrame:
    """``docs`` with topic, tokens, probability and sampled. ``targets``: for each margin shares by value, or a power; ``budget``: the least share of all tokens to take."""
    targets = {m: POWER for m in MARGINS} | dict(targets or {})
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.withColumn("__tokens", count_words(F.col("text")))
    named = counted.withColumns({"__source": F.coalesce("source", F.lit(NONE)), "__lang": F.coalesce("lang", F.lit(NONE)), "__topic": topic_of(text, F.col("__tokens"))})
    cell = named.select(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"))
    cells = stored(cell.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets, sweeps, budget)
    rates = stored(raked.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], (F.col("weight") / F.col("tokens")).alias("probability")))
    out = named.join(rates, [f"__{m}" for m in MARGINS], "left")
    probability = F.when(F.col("__tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    names = [c for c in docs.columns if c not in ("topic", "tokens", "probability", "sampled")]
    out = out.select(*names, F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), probability.alias("probability"))
    return out.withColumn("sampled", sample_uniform(F.col("doc_id"), seed) < F.col("probability"))
