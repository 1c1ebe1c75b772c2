"""Hashed maximum-entropy language model with a class-factored softmax.

log P(word | context) = log P(class | context) + log P(word | class, context), a softmax
each.  Classes are the end of a text and hashes of a word's last two bytes.  Inside a
class the most frequent words have a slot each; slot 0 holds all others, unknown ones
too, which share it by their smoothed counts.  Both scores are the log prior and the
weights of hashed features of the context: the last word, the last two words, and the
words two and three places back (skip features); inside a class the features are hashed
together with the class.

Training is by whole-batch gradient rounds.  In each, all tasks sum over all training
documents what was observed of every feature and outcome, or what the model expects,
and a weight moves by RATE times the log of their smoothed ratio, a step in the
gradient's direction (observed less expected).  Sums don't depend on how the documents
are dealt to tasks, so neither does the model, up to rounding.  The number of hashed rows grows with the training
tokens up to ROWS, which bounds what a task adds to the shuffle (8 MB a round).

Counts are over all training documents.  The counts of the most frequent words (at
most HEAD) are broadcast, 20 MB at most; tokens of all other words are joined with
the full count table, so nothing depends on the size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, keep
from .textkit import SPACED, Lookup, Words, chunks, mix

CLASSES, SLOTS = 32, 32  # class 0: the end of a text; slot 0: all words of a class without a slot of their own
ROWS = 1 << 15  # most hashed feature rows of each factor
HEAD = 1 << 20  # most words with broadcast counts
RATES, SMOOTH = (0.5, 0.25), 64.0  # one rate a round; how many tokens of the prior a row starts with
TOGETHER = 32_768  # tokens scored at once
BLOCK = 4096  # tokens whose weights are gathered at once
PIECES, FAN = 64, 64  # pieces of the sums, and groups of tasks, when they are added up
_END = np.uint64(0x5851F42D4C957F2D)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FEATURES = 4


def suffix_class(words: Words) -> np.ndarray:
    last = words.data[words.end - 1].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    long = words.end - words.start > 1
    before = np.where(long, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64) if len(words) else last
    return (1 + mix(last * np.uint64(256) + before) % np.uint64(CLASSES - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, most=8_000_000):
        parts = []
        for piece in chunks(iter([batch])):
            words = Words(piece.column("text"), SPACED)
            parts.append((words.hash, suffix_class(words).astype(np.int8)))
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, at, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(c[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "kind", "n"]
        )


class Model:
    """What scoring needs: all of bounded size."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, ends: int):
        """Head words with counts and classes; tokens and distinct words of each class over all words; the number of ends."""
        order = np.argsort(keys)
        keys, counts, kinds = keys[order], counts[order], kinds[order]
        self.lookup, self.counts, self.ends = Lookup(keys), counts, ends
        self.tokens, self.words = int(class_tokens.sum()) + ends, int(class_words.sum()) + bool(ends)
        self.base_norm = np.log10(self.tokens + self.words + 1.0)
        # the words of most counts of each class have slots 1 and on
        by_count = np.lexsort((keys, -counts, kinds))
        place = np.arange(len(keys)) - np.searchsorted(kinds[by_count], kinds[by_count])
        chosen = by_count[place < SLOTS - 1]
        slot = place[place < SLOTS - 1] + 1
        again = np.argsort(keys[chosen])
        chosen, slot = chosen[again], slot[again]
        self.own, self.slot = Lookup(keys[chosen]), slot
        shares = np.zeros((SLOTS, CLASSES))
        shares[slot, kinds[chosen]] = counts[chosen]
        rest_tokens, rest_words = class_tokens - shares.sum(0), class_words - (shares > 0).sum(0)
        shares[0] = rest_tokens + rest_words + 1.0
        self.norm = np.log10(shares[0])
        whole = class_tokens + 1.0
        whole[0] = ends + 1.0
        with np.errstate(divide="ignore"):
            self.class_prior = np.log(whole / whole.sum()).astype(np.float32)
            self.slot_prior = np.log(shares / shares.sum(0)).astype(np.float32)
        self.rows = min(ROWS, max(1 << 10, 1 << max(0, self.tokens.bit_length() - 9)))
        self.weights = np.zeros((2, CLASSES, self.rows), np.float32)
        self.turned: tuple[np.ndarray, np.ndarray] | None = None  # the weights, and the same by rows

    def stream(self, column: pa.Array):
        """Hashes, classes, slots and documents of all tokens, an end after each document's words; feature rows of both factors."""
        words = Words(column, SPACED)
        docs = len(words.first) - 1
        place = np.arange(len(words)) + words.doc
        total = len(words) + docs
        h = np.full(total, _END)
        h[place] = words.hash
        cls = np.zeros(total, np.int64)
        cls[place] = suffix_class(words)
        slot = np.zeros(total, np.int64)
        at = self.own(words.hash)
        slot[place] = np.where(at >= 0, self.slot[np.maximum(at, 0)], 0) if len(self.slot) else 0
        doc = np.repeat(np.arange(docs), np.diff(words.first) + 1)
        before = np.concatenate([np.full(3, _END), h])  # a document's start looks like an end before it
        w1, w2, w3 = before[2:-1], before[1:-2], before[:-3]
        back = np.arange(total) - (words.first[:-1] + np.arange(docs))[doc]
        w2 = np.where(back < 2, _END, w2)
        w3 = np.where(back < 3, _END, w3)
        m, inner = np.uint64(self.rows - 1), self.rows // CLASSES
        seen = (w1, w2 * np.uint64(5), w3 * np.uint64(7), w1 * np.uint64(3) + w2 * _GOLD)
        by_class = np.stack([((x * _GOLD >> np.uint64(40)) & m).astype(np.int64) for x in seen])
        by_slot = np.stack([((x * _GOLD >> np.uint64(24)) % np.uint64(inner)).astype(np.int64) + cls * inner for x in seen])  # a row is of one class
        return h, cls, slot, doc, (by_class, by_slot)

    def scores(self, factor: int, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """(outcomes, tokens): log prior and weights."""
        if self.turned is None or self.turned[0] is not self.weights:  # a row's weights stand together, so a token reads one place a feature
            self.turned = self.weights, np.ascontiguousarray(self.weights.transpose(0, 2, 1))
        w = self.turned[1][factor]
        s = np.empty((CLASSES, rows.shape[1]), np.float32)
        for a in range(0, rows.shape[1], BLOCK):
            x = np.take(w, rows[0, a : a + BLOCK], axis=0)
            for k in range(1, _FEATURES):
                x += np.take(w, rows[k, a : a + BLOCK], axis=0)
            s[:, a : a + BLOCK] = x.T
        s += self.slot_prior[:, cls] if factor else self.class_prior[:, None]
        s -= s.max(0)
        return s

    def log_probability(self, factor: int, outcome: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's outcome under one factor."""
        out = np.empty(len(outcome))
        for a in range(0, len(outcome), TOGETHER):
            s = self.scores(factor, rows[:, a : a + TOGETHER], cls[a : a + TOGETHER])
            right = s[outcome[a : a + TOGETHER], np.arange(s.shape[1])]
            out[a : a + TOGETHER] = (right - np.log(np.exp(s, out=s).sum(0))) / np.log(10)
        return out

    def observe(self, sums: np.ndarray, factor: int, outcome: np.ndarray, rows: np.ndarray) -> None:
        for k in range(_FEATURES):
            sums[factor] += np.bincount(outcome * self.rows + rows[k], minlength=CLASSES * self.rows).reshape(CLASSES, -1)

    def expect(self, sums: np.ndarray, factor: int, rows: np.ndarray, cls: np.ndarray) -> None:
        for a in range(0, len(cls), TOGETHER):
            r = rows[:, a : a + TOGETHER]
            p = np.exp(self.scores(factor, r, cls[a : a + TOGETHER]))
            p /= p.sum(0)
            for k in range(_FEATURES):
                for outcome in range(CLASSES):
                    sums[factor, outcome] += np.bincount(r[k], p[outcome], self.rows)

    def prior_of_rows(self) -> np.ndarray:
        """Prior probability of each outcome in each row of both factors."""
        inner = self.rows // CLASSES
        return np.stack([np.repeat(np.exp(self.class_prior)[:, None], self.rows, 1), np.repeat(np.exp(self.slot_prior), inner, 1)])

    def move(self, observed: np.ndarray, expected: np.ndarray, rate: float) -> None:
        weight = SMOOTH * self.prior_of_rows()
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log((observed + weight) / (expected + weight))
        self.weights = self.weights + (rate * np.where(weight > 0, step, 0)).astype(np.float32)


def _sums(batches: Iterator[pa.RecordBatch], model, expected: bool) -> Iterator[pa.RecordBatch]:
    """A task's sums over its documents, in pieces."""
    from pyspark import TaskContext

    m, met = model.value, False
    sums = np.zeros((2, CLASSES, m.rows))
    for batch in chunks(batches):
        _, cls, slot, _, rows = m.stream(batch.column("text"))
        met = met or len(cls) > 0
        for factor, outcome in enumerate((cls, slot)):
            if expected:
                m.expect(sums, factor, rows[factor], cls)
            else:
                m.observe(sums, factor, outcome, rows[factor])
    if met:
        parts = sums.astype(np.float32).reshape(PIECES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PIECES), pa.int32()), pa.array([TaskContext.get().partitionId() % FAN] * PIECES, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
            names=["piece", "fan", "sums"],
        )


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in group["sums"])
    return pa.table({"piece": group["piece"][:1], "fan": group["fan"][:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in chunks(batches):
        h, cls, slot, doc, rows = m.stream(batch.column("text"))
        docs = batch.num_rows
        at = m.lookup(h)
        end = h == _END
        head = (at >= 0) | end
        c = np.where(at >= 0, m.counts[np.maximum(at, 0)], 0) if len(m.counts) else np.zeros(len(h), np.int64)
        c[end] = m.ends
        log_count = np.where(head, np.log10(c + 1.0), 0)
        n = np.bincount(doc, minlength=docs)
        rest = (slot == 0) & ~end
        factored = m.log_probability(0, cls, rows[0], cls) + np.where(end, 0, m.log_probability(1, slot, rows[1], cls)) + np.where(rest, log_count - m.norm[cls], 0)
        tail = np.flatnonzero(~head)
        # one entry for each document and word
        order = tail[np.lexsort((h[tail], doc[tail]))]
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.concatenate([first, [len(order)]])).astype(np.int32)
        names, owner = h[order[first]].view(np.int64), doc[order[first]]
        offsets = np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)),
                pa.array(np.bincount(doc, weights=head & (c > 0), minlength=docs).astype(np.int64)),
                pa.array(np.bincount(doc, weights=log_count, minlength=docs) - n * m.base_norm),
                pa.array(np.bincount(doc, weights=factored, minlength=docs)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(names)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(many)),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "times"],
        )


def prepare(docs: DataFrame, held_out: str) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.expr(held_out).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _gathered(train: DataFrame, model: Model, expected: bool) -> np.ndarray | None:
    """What all training documents sum to; of a fixed size, one row a piece."""
    sent = train.sparkSession.sparkContext.broadcast(model)
    got = (
        train.select("text").mapInArrow(lambda it: _sums(it, sent, expected), "piece int, fan int, sums binary")
        .groupBy("piece", "fan").applyInArrow(_added, "piece int, fan int, sums binary")
        .groupBy("piece").applyInArrow(_added, "piece int, fan int, sums binary").collect()
    )
    sent.unpersist()
    if not got:
        return None
    return np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(got, key=lambda r: r["piece"])]).reshape(2, CLASSES, -1).astype(np.float64)


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the texts in column `text`, and the kept table of all its word counts (word, kind, n)."""
    counts = keep(
        train.select("text").mapInArrow(_counted, "word long, kind int, n long")
        .groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n")),
        "counts",
    )
    ends = train.count()
    # the least count whose words fit the head, from counts in quarter powers of two
    level = F.floor(F.log2("n") * 4)
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    least, size = None, 0
    for r in sizes:
        size += r["count"]
        if size > HEAD:
            break
        least = r["level"]
    head = (counts.where(level >= least) if least is not None else counts.limit(0)).toArrow()
    by_class = np.zeros((2, CLASSES))
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # one row a class
        by_class[:, r["kind"]] = r["n"], r["v"]
    model = Model(head["word"].to_numpy().view(np.uint64), head["n"].to_numpy(), head["kind"].to_numpy(), *by_class, ends)
    observed = _gathered(train, model, False)
    if observed is not None:
        # before any weight is learnt the model expects every outcome by its prior
        expected = model.prior_of_rows() * observed.sum(1, keepdims=True)
        for k, rate in enumerate(RATES):
            model.move(observed, expected if k == 0 else _gathered(train, model, True), rate)
    return model, counts


def maxent_scores(docs: DataFrame, held_out: str = "coalesce(crc32(cast(doc_id AS string)), 0) % 7 = 2") -> DataFrame:
    """Each document's log10 probability under the unigram baseline and under the model.

    docs: doc_id, text; other columns are ignored.  A null text is empty: its only
    token is the end.  The model learns from rows where `held_out` (SQL) is false.
    Repeated rows are scored each and learnt from each; of words with equal counts those
    of least hash get a slot.  Without training rows all
    words are unknown.  Result: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = prepare(docs, held_out)
    model, counts = fit(rows.where("NOT held_out"))
    sent = spark.sparkContext.broadcast(model)
    scored = keep(
        rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(
            lambda it: _scored(it, sent),
            f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, "
            "base_score double, score double, tail array<long>, times array<int>",
        ),
        "scored",
    )
    tail = scored.where("size(tail) > 0").select("row", F.explode(F.arrays_zip("tail", "times")).alias("t"))
    rest = keep(
        tail.select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times")).join(counts.select("word", "n"), "word")
        .groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("part")),
        "tail",
    )
    forget(counts)
    part = F.coalesce("part", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + part).alias("base_score"), (F.col("score") + part).alias("score"),
    )
