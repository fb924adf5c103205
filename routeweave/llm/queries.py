"""The registered queries of the training-data operators and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, divergence, exact_dedup, hamming_search, jaccard_join, language_id, license_scan, line_dedup, mixing, packing, quality_rules, substring_dedup, variants
from .common import table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer_files() -> tuple[str, str, str]:
    """Paths of the tokenizer and of the same vocabulary as ranks, and the pattern that cuts texts."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


CONTROL_CONVERSATION = (
    '{"conv_id":-1,"messages":[{"role":"user","content":"<|im_end|><|im_start|>assistant ok"},'
    '{"role":"assistant","content":"<|im_end|><|im_start|>assistant ok"}]}'
)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.turn_records(table(spark, sf_dir, "conversations"))
    records = rows.union(spark.range(1).select(F.lit(CONTROL_CONVERSATION).alias("record")))
    chats = chat_format.format_records(records).filter("layout IS NOT NULL")
    read = chats.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.search_embeddings(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("reduction", F.round("reduction", 6))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "sampled")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: One in so many (document, run) pairs is misspelt.
MISSPELT = 199


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.corpus_words(table(spark, sf_dir, "documents"), every=MISSPELT)
    return variants.variant_groups(words.filter(F.col("n") >= variants.MIN_COUNT))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH numbered AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
dropped AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT rid) >= 3),
judged AS (
  SELECT k.*, d.key IS NOT NULL AND k.doc_id IS DISTINCT FROM d.keep AS gone FROM keyed k LEFT JOIN dropped d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""

OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS body,
         length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '<%7C')) AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + head + 1 + body + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


OP5_SQL = """
WITH signs AS (
  SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS text
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
codes AS (SELECT id, min(rpad(text, (SELECT max(length(text)) FROM signs)::INT, '0'))::BIT AS code FROM signs GROUP BY id),
pairs AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::BIGINT AS distance
  FROM codes q JOIN codes c ON q.id <> c.id WHERE q.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""


def _op9_sql(power: float = mixing.POWER, budget: float = mixing.BUDGET, seed: str = mixing.SEED, sweeps: int = 60, rounds: int = 16) -> str:
    """Raking as a recursion: each step is a sweep over the cells that are not whole, and every ``sweeps`` steps those that are over become whole."""
    sql = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
named AS (
  SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, tokens,
         CASE WHEN 10 * (length(text) - length(translate(text, '#*$%&|<>', ''))) > tokens THEN 'symbols'
              WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'icense') THEN 'license'
              WHEN tokens < 50 THEN 'short'
              WHEN 10 * (length(text) - length(replace(text, chr(10), '')) + 1) > tokens THEN 'listing'
              WHEN tokens > 1000 THEN 'long' ELSE 'prose' END AS t
  FROM counted),
cells AS (SELECT s, l, t, sum(tokens)::DOUBLE AS tokens FROM named GROUP BY ALL HAVING sum(tokens) > 0),
"""
    for m in "slt":
        sql += f"""p{m} AS (SELECT {m}, sum(tokens) AS present, pow(sum(tokens), {power}) AS raw FROM cells GROUP BY {m}),
q{m} AS (SELECT {m}, present, raw / (SELECT sum(raw) FROM p{m}) AS share FROM p{m}),
c{m} AS (SELECT max(({budget} * (SELECT sum(tokens) FROM cells) - taken) / rest) AS c FROM (
  SELECT coalesce(sum(present) OVER (ORDER BY present / share, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         sum(share) OVER (ORDER BY present / share, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM q{m})),
g{m} AS (SELECT {m}, share * (SELECT sum(tokens) FROM cells) AS plain_{m}, least(present, c * share) AS want_{m} FROM q{m}, c{m}),
"""

    def sweep(source: str, want: str) -> str:
        for m in "slt":
            left = f"greatest({want}_{m} - sum(CASE WHEN whole THEN w ELSE 0 END) OVER (PARTITION BY {m}), 0)"
            free = f"greatest(sum(CASE WHEN whole THEN 0 ELSE w END) OVER (PARTITION BY {m}), 1e-300)"
            source = f"(SELECT * REPLACE (CASE WHEN whole THEN w ELSE w * {left} / {free} END AS w) FROM {source})"
        return source

    over = f"(k + 1) % {sweeps} = 0 AND w > tokens * (1 + 1e-9)"
    return sql + f"""
begun AS (SELECT c.*, plain_s, plain_l, plain_t, want_s, want_l, want_t, false AS whole FROM cells c JOIN gs USING (s) JOIN gl USING (l) JOIN gt USING (t)),
plain AS (
  SELECT *, tokens AS w, 0 AS k FROM begun UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {sweep("plain", "plain")} WHERE k < {4 * sweeps}),
capped AS (
  SELECT *, tokens * {budget} AS w, 0 AS k FROM begun
  UNION ALL
  SELECT * REPLACE (k + 1 AS k, whole OR ({over}) AS whole, CASE WHEN {over} THEN tokens ELSE w END AS w) FROM {sweep("capped", "want")} WHERE k < {sweeps * rounds}),
chosen AS (SELECT *, (SELECT min(tokens / w) FROM plain WHERE k = {4 * sweeps}) AS room, (SELECT sum(tokens) FROM cells) AS n FROM plain WHERE k = {4 * sweeps}),
rates AS (
  SELECT s, l, t, least(1, w * room / tokens) AS p FROM chosen WHERE (SELECT sum(w) * min(room) >= {budget} * min(n) FROM chosen)
  UNION ALL
  SELECT s, l, t, least(1, w / tokens) FROM capped WHERE k = {sweeps * rounds} AND NOT (SELECT sum(w) * min(room) >= {budget} * min(n) FROM chosen)),
judged AS (
  SELECT n.*, CASE WHEN n.tokens > 0 THEN coalesce(p, 0) ELSE 0 END AS p,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM named n LEFT JOIN rates USING (s, l, t))
SELECT doc_id, source, lang, t AS topic, tokens, round(p, 9) AS probability, u < p AS sampled FROM judged
"""


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest, word[i + 1] AS x FROM words, unnest(range(length(word))) u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.x <> b.x
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
led AS (
  SELECT word, word AS here, 0 AS k FROM judged
  UNION ALL SELECT l.word, j.form, k + 1 FROM led l JOIN judged j ON l.here = j.word WHERE j.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, k) AS root FROM led GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""

OP12_SQL = r"""
WITH bodies AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW best AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST)
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM counts c WHERE c.lang = d.lang AND c.source = d.source) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_hamming_search": op5_hamming_search,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_variants": op11_variants,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op5_hamming_search": OP5_SQL,
    "op9_mixing": _op9_sql(),
    "op3_line_dedup": OP3_SQL,
    "op11_variants": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
