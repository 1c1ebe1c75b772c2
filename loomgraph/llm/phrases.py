"""Phrase collocation mining by word-id suffix arrays.

A task reads its texts in shards of some megabytes.  A shard's words become dense ids;
prefix doubling in numpy sorts its suffixes by their first words, and the intervals of
the suffix array whose common prefix is at least n words long are its n-grams, with
their counts.  Counts of all shards are summed by key.

An n-gram is frequent only if all words and word pairs in it are, so the counting goes
up: words, then pairs of frequent words, then longer runs of frequent pairs; in these
rounds a key is a 64-bit hash, and the frequent keys are handed on as a bitmap of fixed
size, whatever their number; a bit that is shared only lets an n-gram through.  Counts are
summed by 64-bit hashes of the n-grams and their language.  With each goes the least of its documents'
hashes, and in a last round only those documents spell the n-gram, so that its text is
not gathered from every task.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bounded, keep, release
from .textkit import Words, chunks, grams, mix, raw

#: fixed values: bytes that end a piece, and those that end a word (these too)
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~PIECE_END
INSIDE[[0x20, 0x09]] = False

SHARD_BYTES = 6_000_000
#: bits of a document's name, and the hash of an n-gram that a document of some name spells
NAME = 24
NAMED = f"key ^ shiftleft(cast(name as long), {64 - NAME})"
#: log2 of the bitmap's bits; 8 MB, and at most 16 MB come to the driver for it
BITS = 26
#: most languages whose totals are sent to all tasks
LANGS = 10_000
#: parts a language's phrases are ranked in before they are ranked together
PARTS = 64


class Known:
    """A bitmap of hashed n-grams."""

    def __init__(self) -> None:
        self.bits = np.zeros(1 << (BITS - 6), np.uint64)

    def add(self, counted: DataFrame, key: str = "key") -> None:
        """Also the keys of `counted`; Spark makes the bitmap's 64-bit parts, the driver puts them together."""
        at = F.shiftrightunsigned(F.expr(key), 64 - BITS)
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        found = counted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("part")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.bits[found["part"].to_numpy()] |= found["bits"].to_numpy().view(np.uint64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = key >> np.uint64(64 - BITS)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` ids at least, and how many of these each shares with the one before it.

    ids: from 1; left: ids from each place to its run's end, itself included; a suffix
    ends with its run.  Ranks are doubled: those of 2k ids come from two of k.
    """
    rank, k = ids, 1
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while k < depth:
        after = np.zeros_like(rank)
        more = np.flatnonzero(left > k)
        after[more] = rank[more + k]
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(pair, kind="stable")
        new = np.empty(len(pair), bool)
        new[:1] = True
        new[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        k *= 2
    common = np.zeros(len(ids), np.int64)
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for n in range(depth):
        same = same[(left[a[same]] > n) & (left[b[same]] > n)]
        same = same[ids[a[same] + n] == ids[b[same] + n]]
        common[same + 1] += 1
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, left: np.ndarray, n: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of every n-gram, its count and the least value of its places: the maximal intervals of suffixes that share n ids."""
    first = np.flatnonzero(common < n)
    count = np.diff(np.append(first, len(order)))
    least = np.minimum.reduceat(value[order], first)
    at = order[first]
    whole = left[at] >= n
    return at[whole], count[whole], least[whole]


class Shard:
    """The words of some documents as runs: words that follow one another in a piece.

    hash: of each word and its document's language; together: whether a word stands in one piece with the next.
    """

    def __init__(self, batch: pa.RecordBatch):
        words = self.words = Words(batch.column("text"), INSIDE)
        spans = words.at.tolist()
        self.name = np.array([zlib.crc32(words.data[a:b]) >> (32 - NAME) for a, b in itertools.pairwise(spans)], np.int64)
        self.langs = [x if x is not None else "und" for x in batch.column("lang").to_pylist()]
        salt = Words(pa.array([f"l{x}" for x in self.langs]), np.ones(256, bool), lower=False).hash if self.langs else np.zeros(0, np.uint64)
        self.hash = mix(words.hash ^ salt[words.doc]) if len(words) else words.hash
        ends = np.zeros(len(words.data) + 1, np.int32)
        np.cumsum(PIECE_END[words.data], out=ends[1:])
        self.together = np.zeros(len(words), bool)
        if len(words) > 1:
            self.together[:-1] = (ends[words.start[1:]] == ends[words.end[:-1]]) & (words.doc[1:] == words.doc[:-1])

    def counted(self, sizes: range, known: Known | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, places, keys, counts, least names of their documents) of the n-grams whose words and pairs are known."""
        place, together = np.arange(len(self.hash)), self.together.copy()
        if known is not None:
            fine = known(grams(self.hash, 1))
            together[:-1] &= fine[1:]
            together &= fine
            if sizes[-1] > 2 and len(together) > 1:
                together[:-1] &= known(grams(self.hash, 2))
            place = place[fine]
        if not len(place):
            return
        run = np.flatnonzero(~together)  # the last word of each run
        left = run[np.searchsorted(run, place)] - place + 1
        if sizes[0] > 1:  # of runs that are too short nothing counts
            first = np.concatenate([[0], run[:-1] + 1])
            long = (run - first + 1 >= sizes[0])[np.searchsorted(run, place)]
            place, left = place[long], left[long]
            if not len(place):
                return
        _, ids = np.unique(self.hash[place], return_inverse=True)
        order, common = suffix_array(ids.astype(np.int64) + 1, left, sizes[-1])
        name = self.name[self.words.doc[place]]
        for n in sizes:
            at, count, least = intervals(order, common, left, n, name)
            at = place[at]
            key = np.full(len(at), np.uint64(n))
            for k in range(n):
                key = key * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + k]
            yield n, at, mix(key), count, least

    def text(self, at: int, n: int) -> bytes:
        w = self.words
        return b" ".join([w.data[w.start[k] : w.end[k]].tobytes() for k in range(at, at + n)])


def _keys(texts: DataFrame, sizes: range, known, least: int) -> DataFrame:
    """key, f and name (the least of its documents') of the n-grams met `least` times and more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=SHARD_BYTES):
            for _, _, key, f, name in Shard(batch).counted(sizes, known.value if known else None):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f.astype(np.int64)), pa.array(name.astype(np.int32))], names=["key", "f", "name"])

    rows = texts.mapInArrow(count, "key long, f long, name int")
    return rows.groupBy("key").agg(F.sum("f").alias("f"), F.min("name").alias("name")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """lang, phrase, k (its words) and f of every phrase of 1 to `longest` words met `least` times in its language.

    A row with a null phrase has all word occurrences of a language.  docs: any columns
    with text and lang; null texts are empty, a null lang is `und`; repeated rows count
    each; an empty table gives none.
    """
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.select("text", "lang")
    found, chosen, known, frequent = Known(), Known(), None, None
    for sizes in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if sizes and sizes[-1] <= longest:
            counted = keep(_keys(texts, sizes, known, least), "keys")
            found.add(counted)
            chosen.add(counted, NAMED)
            frequent = counted if frequent is None else frequent.unionByName(counted)
            if known is not None:
                known.unpersist()
            known = spark.sparkContext.broadcast(found)
            release(spark)  # a round's shuffle files aren't read again
    namers = spark.sparkContext.broadcast(chosen)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in chunks(batches, most=SHARD_BYTES):
            shard = Shard(batch)
            for lang, n in zip(shard.langs, np.diff(shard.words.first).tolist(), strict=True):
                words[lang] += n
            for n, at, key, _, name in shard.counted(range(1, longest + 1), known.value):
                hot = np.flatnonzero(known.value(key) & namers.value(key ^ (name.astype(np.uint64) << np.uint64(64 - NAME))))
                for a in range(0, len(hot), 50_000):
                    some = hot[a : a + 50_000]
                    langs = [shard.langs[d] for d in shard.words.doc[at[some]].tolist()]
                    yield _rows(langs, [shard.text(i, n) for i in at[some].tolist()], n, key[some].view(np.int64), [0] * len(some))
        yield _rows(list(words), [None] * len(words), 0, [None] * len(words), list(words.values()))

    rows = texts.mapInArrow(spell, "lang string, phrase string, k int, key long, f long")
    once = rows.groupBy("key", F.when(F.col("key").isNull(), F.col("lang")).alias("of")).agg(F.min(F.struct("lang", "phrase", "k")).alias("p"), F.sum("f").alias("words"))
    spelt = keep(once.select("key", "p.*", "words"), "phrases")
    counted = spelt.drop("words").join(frequent.select("key", "f"), "key").select("lang", "phrase", "k", "f")
    return counted.unionByName(spelt.where("key IS NULL").select("lang", "phrase", "k", F.col("words").alias("f")))


def _rows(langs: list, phrases: list, n: int, key, f: list) -> pa.RecordBatch:
    text = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), text, pa.array(np.full(len(langs), n, np.int32)), pa.array(key, pa.int64()), pa.array(f, pa.int64())], names=["lang", "phrase", "k", "key", "f"])


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's count; a cut after some words gives l and r, the counts of its parts,
    and floor(1000 * a * n / (l * r)), n the language's words; the lowest of a phrase's
    cuts counts, the shortest left part on ties.  A phrase that stands in a longer one as
    often as at all is left out.  Ranked by score, then a, both falling, then the phrase's bytes.
    Rows as `phrase_counts` takes them; products are decimals of 38 digits.
    """
    counts = keep(phrase_counts(docs, longest, least), "counts")
    total = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    if total.count() <= LANGS:  # else a join by language, which one language may fill
        total = F.broadcast(total)
    known = counts.where("phrase IS NOT NULL").withColumn("words", F.split("phrase", " "))
    phrases = known.where("k > 1")
    # a longer phrase as frequent goes through one that is longer by one word
    inner = lambda a: F.array_join(F.slice("words", a, F.col("k") - 1), " ")
    covered = phrases.where("k > 2").select("lang", F.explode(F.array(inner(1), inner(2))).alias("phrase"), "f").distinct()
    own = phrases.join(covered, ["lang", "phrase", "f"], "left_anti")
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cut = F.col("cut")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), cut).alias("left"), part(cut + 1, F.col("k") - cut).alias("right"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    exact = "cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r", "a", "n")).alias("c")).select("lang", "phrase", "c.*")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*by))
    ahead = best.withColumn("place", some).where(F.col("place") <= top)  # first in parts: a language may hold all phrases
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
