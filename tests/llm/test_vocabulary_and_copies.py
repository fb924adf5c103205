"""Variant grouping, exact dedup and the divergence audit against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeweave.llm import divergence, exact_dedup, golomb, variants

BLANKS = " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def with_extra(docs):
    return docs.withColumns({c: F.lit(c) for c in ("part", "pos", "fp", "digest", "body", "n", "word", "term", "block", "total", "p", "best")})


# ---- exact dedup
def brute_copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        body = (text or "").translate({ord(c): None for c in BLANKS})
        groups[body].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        first, *others = sorted(members)
        out += [(m[3], first[3], len(members), m is first, hashlib.sha256(body.encode()).hexdigest()) for m in [first, *others]]
    return sorted(out, key=repr)


def copies(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"part_rows": 3, "owner_rows": 2, "spare": 1}])
def test_exact_groups(docs, rows, limits):
    assert copies(exact_dedup.exact_groups(with_extra(docs), **limits)) == brute_copies([r[:2] for r in rows])


def test_exact_groups_ties_nulls_and_repeated_rows(spark, empty):
    rows = [(3, "a b"), (1, "ab "), (2, " a\tb\n"), (2, " a\tb\n"), (None, "x"), (None, "x"), (5, None), (4, ""), (6, " "), (None, " "), (7, "é a"), (8, "éa")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert copies(got) == brute_copies(rows)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprinted")]


def test_exact_groups_one_text_everywhere(spark):
    docs = spark.range(0, 3000, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000").agg(F.count("*"), F.min("keep_id"), F.max("keep_id")).first() == (1000, 0, 0)


def test_exact_groups_string_ids(spark):
    got = exact_dedup.exact_groups(spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string"))
    assert sorted(r[:4] for r in copies(got)) == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def test_suspects_follow_the_bitmaps(spark):
    """A row is a suspect only if another row sends its fingerprint; rows that are suspected falsely do not join a group."""
    exchange = exact_dedup.Exchange(4, 1, spare=1)
    assert exchange.width < 8
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    got = exact_dedup.exact_groups(docs, part_rows=16, spare=1)
    assert got.filter("kept AND group_size = 1").count() == 200


@pytest.mark.parametrize(("n", "width"), [(0, 8), (1, 63), (2, 1), (500, 9), (20000, 40), (300, 63)])
def test_golomb(n, width):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << width, n).astype(np.uint64))
    k, unary, rest = golomb.encode(values)
    assert (golomb.decode(len(values), k, unary, rest) == values).all()
    if n == 20000:
        assert 8 * (len(unary) + len(rest)) < 29 * n  # log2(2^40 / 20000) + 1.5 is 27.2, in place of 40


# ---- divergence audit
def brute_audit(rows, min_docs=10, top=10):
    found, groups, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(terms)
        langs[lang or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in found[lang].items() if n >= min_docs]

        def share(counts, term, kept=kept):
            return 1 + 1_000_000_000 * (counts[term] + 2) // (sum(counts[t] for t in kept) + 2 * len(kept))

        def parts(p, q):
            return (p - q) ** 2 // (p + q)

        own = groups[lang, source]
        pairs = [(-sum(parts(share(own, t), share(groups[lang, s], t)) for t in kept), s) for a, s in groups if a == lang and s != source]
        terms = [(-parts(share(own, t), share(langs[lang], t)), t) for t in kept if own[t] and share(own, t) > share(langs[lang], t)]
        for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def test_audit_of_the_rows(docs, rows, empty):
    got = divergence.audit_sources(with_extra(docs), min_docs=2).select(*AUDIT)
    assert sorted(map(tuple, got.collect())) == brute_audit([r[1:4] for r in rows], 2)
    assert divergence.audit_sources(empty).count() == 0


@pytest.mark.parametrize("blocks", [{}, {"group_block": 2, "term_block": 5}, {"group_block": 1, "term_block": 1}])
def test_audit_by_blocks(spark, blocks):
    draw = random.Random(5)
    terms = [f"w{chr(97 + k)}" for k in range(20)] + ["Größe", "größe", "ÉTÉ", "éTÉ", "日本", "a1b"]
    rows = [(" ".join(draw.choices(terms, k=draw.randrange(30))), draw.choice(["en", "de", None]), f"s{draw.randrange(7)}") for _ in range(150)]
    rows += [("once only", "xx", "s1"), (None, "xx", "s2"), (None, "xx", None), ("", "yy", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = divergence.audit_sources(df, min_docs=3, top=4, **blocks)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.select(*AUDIT).collect())) == brute_audit(rows, 3, 4)


def test_term_tables_are_emitted_when_full(spark):
    rows = [(f"alpha beta {chr(97 + k % 20)}x gamma", "en", f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    few, many = (sorted(map(str, divergence.term_counts(df, held=h).collect())) for h in (5, 10**6))
    assert few == many and len(many) == 3 * (1 + 3) + 60


# ---- variant grouping
def brute_words(rows, every=None):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'null' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [x for x in counts if differ_by_one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def grouped(df, **limits):
    return sorted(map(tuple, variants.variant_groups(df, **limits).select(*VARIANT).collect()), key=repr)


@pytest.mark.parametrize("every", [None, 3])
@pytest.mark.parametrize("held", [4, 10**6])
def test_corpus_words(docs, rows, every, held):
    got = variants.corpus_words(with_extra(docs), every=every, held=held)
    assert dict(map(tuple, got.collect())) == brute_words([r[:2] for r in rows], every)


def test_corpus_words_letters(spark, empty):
    rows = [(1, "Straße STRASSE Ñandúes ñandúes abĀcdefgh x÷yabcd_abcdef"), (None, "abcdef ABCDEF"), (2, None), (3, ""), (3, "a" * 5000)]
    assert dict(map(tuple, variants.corpus_words(spark.createDataFrame(rows, "doc_id bigint, text string"), every=2).collect())) == brute_words(rows, 2)
    assert variants.variant_groups(variants.corpus_words(empty)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"shard_words": 8, "filter_bytes": 64}])
def test_variant_groups(spark, limits):
    draw = random.Random(3)
    counts = {}
    for stem in ("banana", "aaaaaa", "letters", "größen", "zzÿzzzz"):
        word, n = stem, 100_000
        for _ in range(30):
            counts.setdefault(word, draw.choice([n, n, 7, 400]))
            at, letter = draw.randrange(len(word) + 1), draw.choice("abnzÿà")
            word = draw.choice([stem, word])
            word = draw.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :] if len(word) > 6 else word])
            n = max(5, n // 5)
    counts |= {"long" * 40: 50, "long" * 40 + "x": 5, "long" * 39 + "lonq": 250, "alonebutwell": 6}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    want = brute_variants(counts)
    assert any(r[1] not in (None, r[2]) for r in want)  # a chain of forms
    assert grouped(df, **limits) == want


def test_variants_ties_and_chains(spark):
    counts = {"aaaaaab": 10, "aaaaaac": 50, "aaaaaad": 50, "abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625, "abcdefghijk": 3125, "abcdefghijkl": 15625}
    got = {r[0]: r for r in grouped(spark.createDataFrame(list(counts.items()), "word string, n bigint"))}
    assert got["aaaaaab"] == ("aaaaaab", "aaaaaac", "aaaaaac", 10, 2, 50)
    assert {got[w][2] for w in counts if w.startswith("abc")} == {"abcdefghijkl"}
    assert sorted(got.values(), key=repr) == brute_variants(counts)


def test_false_positives_of_the_filters_go(spark):
    """A filter that answers yes to all gives the same pairs."""
    words = spark.createDataFrame([(w, 5) for w in ("abcdef", "abcdeg", "abcdefg", "xyzxyz")], "word string, n bigint")
    assert variants.near_pairs(words).count() == 3
    shards = variants.Shards({6: 3, 7: 1})
    probe = variants.Probe(shards, {s: b"\xff" * n for s, n in enumerate(shards.bytes)})
    assert len(probe.hits(6, np.arange(50, dtype=np.uint64))) == 50
    found = variants._candidates(words, probe)
    assert found.count() > 1000
    assert found.join(words.select(F.col("word").alias("other")), "other").count() == 3
