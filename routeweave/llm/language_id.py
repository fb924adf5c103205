"""Operator 6: language ID by a linear-chain conditional random field over words.

A word's features are its hashed byte n-grams with word ends (prefixes and suffixes are n-grams that touch an end) and
its identity (the lexicon). Labels are the values of ``lang``; transitions between neighbouring words are learned, so
words of code-switched text are labelled in context. Training data: whole-document labels, and sequences joined from
spans of documents of different languages. Forward-backward gives each word's posterior; a document's language is the
one with most expected words, its score their share.

Training reads at most ``TRAIN_DOCS`` labelled documents for each language (those with the smallest hashes of doc_id) and
``TRAIN_SPANS`` spans of each, cut in tasks, so that the driver gets a bounded number of bytes for each language. The
languages' sizes, one row for each, give the hash bound that the scan applies: no task ranks a language. Prediction
reads every whole text in tasks. There is no shuffle of texts.

Defined cases: a null text, or one without a letter (``str.isalpha``: numbers such as one half or a superscript two are
none), is ``und`` with score 0; ties go to the first language in alphabetical order; with no labelled row everything is
``und``; an empty table yields no rows; rows with null lang are not learned from; rows that repeat a doc_id are predicted
each and learned from once for each lang; a text of more than ``PIECE_CHARS`` code points is labelled in pieces whose
words are counted together, the chain starting anew in each, so that memory is bounded by a piece; extra columns are
carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
TRAIN_DOCS, TRAIN_SPANS, SPAN_WORDS = 300, 3, 24
ORDERS, TABLE_BITS = (2, 3, 4), 17
EPOCHS, RATE, BATCH, SEED = 3, 0.5, 64, 7
#: Bytes of text scored, and of texts labelled, together; code points of a piece of a long text.
SCORE_BYTES, LABEL_BYTES, PIECE_CHARS = 1 << 20, 6 << 20, 2 << 20
#: Bytes of a word that training keeps.
WORD_BYTES = 64
#: How many times the documents that are learned from the hash bound lets through, on average.
OVER = 1.25

_TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_DUMMY = 1 << TABLE_BITS
_POWERS = np.cumprod(np.full(4096, 0x01000193, np.uint32), dtype=np.uint32)


def cleaned(text: str | None) -> bytes:
    """Lower-case words (runs of letters) joined by one space."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK).split())


def pieces(text: str | None) -> Iterator[bytes]:
    """The cleaned pieces of a text, none of them empty; none where the text has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return
    start = 0
    while start < len(text):
        end = start + PIECE_CHARS
        blank = text.rfind(" ", start, end) if end < len(text) else -1
        end = blank if blank > start else end
        if piece := cleaned(text[start:end]):
            yield piece
        start = end


def _slots(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.intp)


def word_features(buffer: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of words between single spaces, one before and one after: the slot of each n-gram by its first byte, for each order;
    where each word's bytes start; and the slot of its identity."""
    a = np.frombuffer(buffer, np.uint8)
    blank = a == 32
    starts = np.flatnonzero(blank)[:-1]
    grams, h, bad = [], a.astype(np.uint32), np.zeros(len(a), bool)
    for n in range(2, max(ORDERS) + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + a[n - 1 :]
        bad = bad[:m] | blank[n - 2 : n - 2 + m] if n > 2 else bad[:m]
        if n in ORDERS:
            slots = np.full(len(a), _DUMMY, np.intp)
            slots[:m] = np.where(bad, _DUMMY, _slots(h + np.uint32(n)))
            grams.append(slots)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    words = np.add.reduceat(a * _POWERS[np.minimum(place, len(_POWERS) - 1)], starts, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)
    return grams, starts, _slots(words ^ np.uint32(0x5BD1E995))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # n-grams and, behind them, words: one row of label scores each
    transitions: np.ndarray

    def emissions(self, texts: list[bytes]) -> np.ndarray:
        """Label scores of all words of cleaned, non-empty texts, one after another."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= SCORE_BYTES or i == len(texts) - 1:
                grams, starts, words = word_features(b" " + b" ".join(held) + b" ")
                total = self.weights[grams[0]]
                for g in grams[1:]:
                    total += self.weights[g]
                out.append(np.add.reduceat(total, starts, axis=0) + self.weights[_DUMMY + 1 + words])
                held, size = [], 0
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def shares(self, emissions: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected share of each label in each document; ``counts``: words of each, all positive. Forward-backward runs
        over all documents at once: step t holds the words t of the documents that are long enough."""
        order = np.argsort(-counts, kind="stable")
        lengths = counts[order]
        first = (np.cumsum(counts) - counts)[order]
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents with more than t words
        at = np.concatenate(([0], np.cumsum(active)))
        rows = np.concatenate([first[:n] + t for t, n in enumerate(active)])
        e = emissions[rows]
        e = np.exp(e - e.max(axis=1, keepdims=True)) + np.float32(1e-9)
        move = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        forward = np.empty_like(e)
        state = e[: active[0]] / e[: active[0]].sum(axis=1, keepdims=True)
        forward[: active[0]] = state
        for t in range(1, longest):
            state = (state[: active[t]] @ move) * e[at[t] : at[t + 1]]
            state /= state.sum(axis=1, keepdims=True)
            forward[at[t] : at[t + 1]] = state
        total = np.zeros((len(counts), len(self.labels)))
        back = np.ones((0, len(self.labels)), np.float32)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if len(back) < n:
                back = np.concatenate([back, np.ones((n - len(back), len(self.labels)), np.float32)])
            posterior = forward[at[t] : at[t + 1]] * back
            posterior /= posterior.sum(axis=1, keepdims=True)
            total[:n] += posterior
            if t:
                back = (back * e[at[t] : at[t + 1]]) @ move.T
                back /= back.sum(axis=1, keepdims=True)
        out = np.empty_like(total)
        out[order] = total / lengths[:, None]
        return out


def cut_spans(text: str, seed: int) -> list[bytes]:
    """``TRAIN_SPANS`` runs of words at places that ``seed`` gives."""
    words = b" ".join(pieces(text)).split()
    starts = np.random.default_rng(seed).integers(0, max(1, len(words) - SPAN_WORDS + 1), TRAIN_SPANS)
    return [b" ".join(w[:WORD_BYTES] for w in words[k : k + SPAN_WORDS]) for k in sorted(starts.tolist())] if words else []


def train(rows: list[tuple[str, list[bytes]]], seed: int = SEED) -> Crf:
    """Fit on (lang, spans) rows by stochastic gradients of the sequence likelihood."""
    random = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in rows})
    spans: list[tuple[int, list[bytes]]] = [(labels.index(lang), span.split()) for lang, own in rows for span in own]
    sequences: list[tuple[list[bytes], list[int]]] = [(w, [y] * len(w)) for y, w in spans]
    for _ in range(len(spans) // 2):  # code-switched
        words, tags = [], []
        for k in random.integers(0, len(spans), 3):
            y, w = spans[k]
            w = w[: int(random.integers(3, SPAN_WORDS + 1))]
            words += w
            tags += [y] * len(w)
        sequences.append((words, tags))
    n, size = len(labels), _DUMMY + 1 + _DUMMY
    model = Crf(labels, np.zeros((size, n), np.float32), np.zeros((n, n), np.float32))
    squares, moved = np.full(size, 1e-3, np.float32), np.full((n, n), 1e-3, np.float32)
    features = []
    for words, tags in sequences:
        grams, starts, own = word_features(b" " + b" ".join(words) + b" ")
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(grams[0]))))
        slots = np.concatenate([*grams, _DUMMY + 1 + own])
        owner = np.concatenate([owner] * len(grams) + [np.arange(len(words))])
        keep = slots != _DUMMY
        features.append((slots[keep], owner[keep], np.array(tags)))
    for _ in range(EPOCHS):
        for part in np.array_split(random.permutation(len(features)), max(1, len(features) // BATCH)):
            slots, grads, step = [], [], np.zeros((n, n), np.float32)
            for k in part:
                s, owner, y = features[k]
                e = np.zeros((len(y), n), np.float32)
                np.add.at(e, owner, model.weights[s])
                posterior, pairs = _marginals(e, model.transitions)
                gold = np.zeros_like(e)
                gold[np.arange(len(y)), y] = 1
                slots.append(s)
                grads.append((gold - posterior)[owner])
                seen = np.zeros((n, n), np.float32)
                np.add.at(seen, (y[:-1], y[1:]), 1)
                step += seen - pairs
            s, which = np.unique(np.concatenate(slots), return_inverse=True)
            g = np.zeros((len(s), n), np.float32)
            np.add.at(g, which, np.concatenate(grads))
            g /= len(part)
            squares[s] += (g * g).mean(axis=1)
            model.weights[s] += RATE * g / np.sqrt(squares[s])[:, None]
            step /= len(part)
            moved += step * step
            model.transitions += RATE * step / np.sqrt(moved)
    return model


def _marginals(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word's label, and expected number of each pair of neighbouring labels, of one sequence."""
    e = np.exp(e - e.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    forward, back = np.empty_like(e), np.ones_like(e)
    forward[0] = e[0] / e[0].sum()
    for t in range(1, len(e)):
        forward[t] = (forward[t - 1] @ move) * e[t]
        forward[t] /= forward[t].sum()
    for t in range(len(e) - 2, -1, -1):
        back[t] = move @ (e[t + 1] * back[t + 1])
        back[t] /= back[t].sum()
    posterior = forward * back
    posterior /= posterior.sum(axis=1, keepdims=True)
    pairs = forward[:-1, :, None] * move[None] * (e * back)[1:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return posterior, pairs.sum(axis=0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learned_from(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[str, list[bytes]]]:
    """(lang, spans) of at most ``train_docs`` documents of each language, never of held-out ones."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.col("text").cast("string"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (OVER * train_docs + 10) / n) * (1 << 30))])
    some = known.filter(F.col("text").isNotNull() & (place < bound[F.col("lang")])).select(place.alias("place"), "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_spans(text, seed) for seed, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.binary()))], names=["place", "lang", "spans"])

    # map-side combined, so that the rows of a repeated id become one
    rows = some.mapInArrow(cut, "place bigint, lang string, spans array<binary>").groupBy("lang", "place").agg(F.min("spans").alias("spans"))
    chosen: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["place"])):  # about OVER * train_docs for each language
        own = chosen.setdefault(r["lang"], [])
        if len(own) < train_docs and r["spans"]:
            own.append((r["lang"], [bytes(x) for x in r["spans"]]))
    return [x for own in chosen.values() for x in own]


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    packed = docs.select(F.col("text").cast("string"), F.struct(*rest).alias("rest"))
    rest_type = packed.schema["rest"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            words, shares, held, size = np.zeros(batch.num_rows), np.zeros((batch.num_rows, len(crf.labels))), [], 0
            for k, text in enumerate(batch.column(0)):
                for piece in pieces(text.as_py()) if crf.labels else ():
                    held.append((k, piece))
                    size += len(piece)
                    if size >= LABEL_BYTES:
                        label(crf, held, words, shares)
                        held, size = [], 0
            if held:
                label(crf, held, words, shares)
            full = words > 0
            named, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if full.any():
                share = shares[full] / words[full, None]
                named[full] = np.array(crf.labels, object)[share.argmax(axis=1)]
                score[full] = np.clip(share.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(named.tolist(), pa.string()), pa.array(score)], names=["rest", "lang_pred", "score"])

    def label(crf: Crf, held: list[tuple[int, bytes]], words: np.ndarray, shares: np.ndarray) -> None:
        """Add each piece's words and the expected words of each label to those of its text."""
        counts = np.array([piece.count(b" ") + 1 for _, piece in held])
        at = np.array([k for k, _ in held])
        np.add.at(words, at, counts)
        np.add.at(shares, at, crf.shares(crf.emissions([piece for _, piece in held]), counts) * counts[:, None])

    return packed.mapInArrow(predict, f"rest {rest_type}, lang_pred string, score double").select("rest.*", "lang_pred", "score")


def language_id(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` with held_out, lang_pred and score. Only text is read for a prediction; only rows that are not held out are learned from."""
    rows = learned_from(docs, train_docs)
    model = train(rows) if rows else Crf([], np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    return identify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
