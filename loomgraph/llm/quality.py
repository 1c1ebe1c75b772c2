"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Tokens are the words of the text as written, and each word's form (capitals, digits,
marks at its end, a coarse length).  Features are word 1- and 2-grams, form 1-, 2- and
3-grams, and whether a word repeats one of the two before it, all hashed to 2**18
buckets.  A feature's value is its share of the document's features, so a score is
one sparse dot product: the mean weight over all n-grams of the whole text.

The classifier is fitted on at most TRAIN_PER_LABEL rows of each label (those first
in hash order); the intercept is then moved to the label shares of all rows it may
learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACED, Words, chunks, mix

BUCKETS = 1 << 18
TRAIN_PER_LABEL = 2048
EPOCHS, SCALE = 6, 16.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
THRESHOLD = 0.7

_UPPER = np.zeros(256, np.uint64)
_UPPER[0x41:0x5B] = 1
_KIND = np.full(256, 3, np.uint64)  # 0 lower, 1 upper, 2 digit, 3 mark, 4 beyond ASCII
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 4


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the document of each, and the number of n-grams of each document."""
    w = Words(column, SPACED, lower=False)
    docs = len(w.first) - 1
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    size = w.end - w.start
    upper = np.concatenate([[0], np.cumsum(_UPPER[w.data])])
    capitals = (upper[w.end] - upper[w.start]).astype(np.int64)
    last = w.data[w.end - 1]
    last2 = np.where(size > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    mark = np.where(_KIND[last] == 3, last.astype(np.uint64) + np.uint64(256) * np.where(_KIND[last2] == 3, last2, 0), 0)
    form = (
        mark.astype(np.uint64) * np.uint64(512) + _KIND[w.data[w.start]] * np.uint64(64)
        + np.where(capitals == 0, 0, np.where(capitals * 2 > size, 2, 1)).astype(np.uint64) * np.uint64(16)
        + np.minimum(size // 3, 7).astype(np.uint64)
    )
    form = mix(form + np.uint64(77))
    back1, back2 = np.zeros(n, bool), np.zeros(n, bool)
    back1[1:] = w.doc[1:] == w.doc[:-1]
    back2[2:] = w.doc[2:] == w.doc[:-2]
    shift = lambda x, k: np.concatenate([np.zeros(k, np.uint64), x[: n - k]]) if n > k else np.zeros(n, np.uint64)
    h, h1, f1, f2 = w.hash, shift(w.hash, 1), shift(form, 1), shift(form, 2)
    p = np.uint64(0x9E3779B97F4A7C15)
    again = np.where(back1 & (h == h1), 2, np.where(back2 & (h == shift(h, 2)), 1, 0)).astype(np.uint64)
    grams = [
        (h * p, None), (h * np.uint64(3) + h1 * p, back1), (form * np.uint64(5), None), (form * np.uint64(7) + f1 * p, back1),
        (form * np.uint64(11) + f1 * p + f2 * np.uint64(13), back2), (mix(again + np.uint64(991)), None),
    ]
    buckets, owner = [], []
    for g, there in grams:
        b = (mix(g) >> np.uint64(46)).astype(np.int64)
        buckets.append(b if there is None else b[there])
        owner.append(w.doc if there is None else w.doc[there])
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    return buckets, owner, np.bincount(owner, minlength=docs)


def margins(column: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    """The log odds of label 1 of each text; an empty one has the intercept alone."""
    buckets, owner, total = features(column)
    return SCALE * np.bincount(owner, weights[buckets], len(total)) / np.maximum(total, 1) + intercept


class FTRL:
    """FTRL-proximal for logistic loss (McMahan et al., 2013) over BUCKETS weights and an intercept."""

    def __init__(self) -> None:
        self.z = np.zeros(BUCKETS + 1)
        self.n = np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in chunks(batches):
        buckets, owner, total = features(batch.column("text"))
        order = np.lexsort((buckets, owner))
        buckets, owner = buckets[order], owner[order]
        edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        for k, (y, key) in enumerate(zip(batch.column("label").to_pylist(), batch.column("turn").to_pylist(), strict=True)):
            at, count = np.unique(buckets[edges[k] : edges[k + 1]], return_counts=True)
            rows.append((key, y, np.append(at, BUCKETS), np.append(SCALE * count / max(1, total[k]), 1.0).astype(np.float32)))
    rows.sort(key=lambda r: r[:2])
    model = FTRL()
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            _, y, at, x = rows[k]
            model.learn(at, x, y)
    w = model.weights(slice(None))
    ones = sum(r[1] for r in rows)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([w[:-1].astype(np.float32).tobytes()], pa.binary()), pa.array([float(w[-1])]),
            pa.array([ones], pa.int64()), pa.array([len(rows) - ones], pa.int64()),
        ],
        names=["weights", "intercept", "ones", "zeros"],
    )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights (1 MB) and intercept from labelled rows.

    labels: doc_id, label 0 or 1; rows with a null in either are left out, a doc_id that
    repeats counts once with its least label, and with the least of its texts if it
    repeats in docs.  One task fits on the bounded sample (2 * TRAIN_PER_LABEL texts);
    without labels of both kinds the score is the share of label 1 everywhere.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    turn = F.xxhash64("doc_id")
    sample = None
    for y in (0, 1):
        one = labels.where(F.col("label") == y).select("doc_id", "label", turn.alias("turn")).orderBy("turn", "doc_id").limit(TRAIN_PER_LABEL)
        sample = one if sample is None else sample.unionByName(one)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    one_each = rows.groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))  # so the sample stays bounded
    got = (
        one_each.select("text", "label", "turn").repartition(1)
        .mapInArrow(_fit, "weights binary, intercept double, ones long, zeros long").first()
    )
    count = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    odds = lambda a, b: np.log((a + 0.5) / (b + 0.5))
    prior = odds(count.get(1, 0), count.get(0, 0))
    if not got or not got["ones"] or not got["zeros"]:
        return np.zeros(BUCKETS, np.float32), float(prior)
    return np.frombuffer(got["weights"], np.float32), float(got["intercept"] + prior - odds(got["ones"], got["zeros"]))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: str = "coalesce(crc32(cast(doc_id AS string)), 0) % 4 = 2") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 where score >= 0.7).

    docs: doc_id, text and any other columns, kept as they are (columns of the three
    names are replaced).  labels: doc_id, label; rows where `held_out` (SQL over
    doc_id) is true are not learnt from.  A null text is scored as an empty one: the
    intercept alone.  Repeated rows are scored each.  An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    docs = docs.select(*kept)
    model = sc.broadcast(fit(docs, labels.where(f"NOT ({held_out})")))
    names = [c for c in kept if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model.value
        for batch in chunks(batches):
            m = margins(batch.column("text"), weights, intercept)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))))], names=[*batch.schema.names, "score"]
            )

    fields = docs.select(*names, "text").schema.add("score", "double")
    return (
        docs.select(*names, "text").mapInArrow(score, fields)
        .select(*kept, F.expr(held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
