"""N-gram Jaccard join through parity sketches.

Each distinct word 5-gram flips one bit of a document's sketch, so the Hamming
distance of two sketches is at most the size of their symmetric difference.  The
sketch is wide (b blocks of 2**40 and more bits) and kept sparse: the odd bits of a
block are folded to one word by XOR.  Sets of Jaccard similarity 4/5 or more differ
in at most (|A| + |B|) / 9 elements and so in as many blocks at most; by the
pigeonhole principle the others agree.  Of its b block words a document therefore
emits only the D + 1 that come first in one fixed order (D: its largest admissible
difference), and qualifying pairs still meet: of the blocks that agree, the first in
that order is emitted by both sides.  The order puts words met often last, which
keeps common passages from forming large groups; any order gives the same result.
If a set's non-empty blocks are at most D, those that agree may all be empty; such a
small set also emits its first elements: 4/5 of them at least are a partner's too, so
the first common one is among the first fifth and one more.

Size bands double; a document emits for its own band and, where a partner can be
just over the edge, for the next one.  Candidates are verified on whole sets.

Groups that share a block word are never expanded to all pairs.  First each member
is compared with the group's smallest member, then over a spanning forest of the closest pairs;
the components of those links swallow whole clusters of copies.  Only pairs from
different components that still share a block word are then all compared, which
makes the result complete: members outside of a group's largest component meet each
other and that component, in tiles.  Groups of two are done with their first pair, and
groups of which the forest left out no pair with the forest.  Before two sets are
fetched, their dense parity sketches (DENSE bits, for large sets 2 to 4 bits an element
too) must be within the admissible distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import forget, keep, release
from .textkit import SPACED, Words, chunks, grams, mix

SHINGLE = 5
#: of block words met often: counted at once by a task, kept of those, and kept in all.  They order the
#: emitted words; no row is dropped.
HOT_COUNTED, HOT_IN_TASK, HOT_IN_ALL = 4_000_000, 16_384, 262_144
LARGE = 1000  # groups of words met so often are told by partial sums, not by a window over the word
SLICES = 4  # the block words meet in so many steps one after another; on disk are the shuffle files of one
TILE = 2048  # most rows of a group that are compared with as many others in one step
#: bits of the dense sketch that filters pairs before their sets are fetched, and of the filter of documents to fetch
DENSE, FILTER_BITS = 1024, 1 << 23
_EMPTY = np.zeros(0, np.uint64)


def sets_of(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one n-gram; without words: none."""
    words = Words(column, SPACED)
    all_grams = grams(words.hash, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(all_grams[a : b - n + 1])
        elif b > a:
            yield grams(words.hash[a:b], b - a, salt=1)
        else:
            yield _EMPTY


def identity(s: np.ndarray) -> int:
    """One signed 64-bit name for a set: equal sets, equal names."""
    with np.errstate(over="ignore"):
        x = mix(s).sum(dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.bitwise_xor.reduce(s, initial=np.uint64(0))
    return int(mix(np.asarray([x + np.uint64(len(s))]))[0].astype(np.int64))


def block_words(s: np.ndarray, bits: int) -> np.ndarray:
    """Words of the non-empty blocks among 2**bits: hash of (band, block, XOR of the block's odd bits)."""
    block = s >> np.uint64(64 - bits) if bits else np.zeros(len(s), np.uint64)
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    folded = np.bitwise_xor.reduceat(mix(s), at)
    return mix(folded + mix(block[at] * np.uint64(64) + np.uint64(bits)))


def meetings(n: int) -> list[tuple[int, int]]:
    """(bits, most): the bands a set of n elements meets others in, and in how many blocks such a pair can differ."""
    bits = n.bit_length() - 1
    top = (2 << bits) - 1  # the largest set of the own band
    out = [(bits, (n + min(n * 5 // 4, top)) // 9)]
    if n * 5 // 4 > top:  # a larger partner has at most 5/4 n elements
        out.append((bits + 1, (n + n * 5 // 4) // 9))
    return out


def _emitted(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The words a set emits, given the words met often and how often."""
    out, few = [], False
    for bits, most in meetings(len(s)):
        words = block_words(s, bits)
        few |= len(words) <= most  # all of them can differ from a partner's
        # The empty blocks are last in the order; what they leave is emitted, first in the order first.
        if len(words) > most + 1:
            at = np.minimum(np.searchsorted(hot[0], words), max(0, len(hot[0]) - 1))
            met = np.where(hot[0][at] == words, hot[1][at], 0) if len(hot[0]) else np.zeros(len(words), np.int64)
            words = words[np.lexsort((words, met))[: most + 1]]
        out.append(words)
    if few:
        out.append(mix(s[: len(s) - (4 * len(s) + 4) // 5 + 1] + np.uint64(2)))
    return np.concatenate(out)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block words that repeat among up to HOT_COUNTED of those of a task's distinct sets."""
    seen: set[int] = set()
    mine: list[np.ndarray] = []

    def top() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate([_EMPTY, *mine]), return_counts=True)
        words, n = words[n > 1], n[n > 1]
        first = np.lexsort((words, -n))[:HOT_IN_TASK]
        return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(n[first])], names=["word", "met"])

    held = 0
    for batch in chunks(batches):
        for s in sets_of(batch.column("text")):
            if len(s) and (name := identity(s)) not in seen:
                seen.add(name)
                mine += [block_words(s, bits) for bits, _ in meetings(len(s))]
                held += 2 * len(s)
        if held > HOT_COUNTED:
            yield top()
            mine, held = [], 0
    yield top()


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT_IN_ALL block words that many sets have, sorted, and how often they were met (4 MB at most)."""
    top = (
        docs.select("text").mapInArrow(_frequent, "word long, met long")
        .groupBy("word").agg(F.sum("met").alias("met")).orderBy(F.desc("met"), "word").limit(HOT_IN_ALL).toArrow()
    )
    words, met = top["word"].to_numpy().view(np.uint64), top["met"].to_numpy()
    order = np.argsort(words)
    return words[order], met[order]


def parity(s: np.ndarray, size: int = DENSE) -> np.ndarray:
    """The dense sketch of a set: `size` bits, each flipped by the elements hashed to it, as 64-bit words.

    The first half of a sketch XOR the second is the sketch of half the size.
    """
    odd = np.bincount((mix(s + np.uint64(1)) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_parity(s: np.ndarray) -> np.ndarray:
    """For large sets a sketch of 2 to 4 bits an element; none for those that DENSE bits serve."""
    return parity(s, 4 << (len(s).bit_length() - 1)) if len(s) >= DENSE else np.zeros(0, np.int64)


def _often(words: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which words were met LARGE times or more."""
    if not len(hot[0]):
        return np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(hot[0], words), len(hot[0]) - 1)
    return (hot[0][at] == words) & (hot[1][at] >= LARGE)


def _describe(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """Per document its set's name and size; for a set's first document in the task its sketches and emitted words, those met often apart."""
    seen: set[int] = set()
    found = hot.value
    none = np.zeros(0, np.int64)
    for batch in chunks(batches):
        names, sizes, words, often, sketches, fines = [], [], [], [], [], []
        for s in sets_of(batch.column("text")):
            name = identity(s)
            new = len(s) > 0 and name not in seen
            names.append(name)
            sizes.append(len(s))
            own = _emitted(s, found) if new else _EMPTY
            many = _often(own, found)
            words.append(own[~many].view(np.int64))
            often.append(own[many].view(np.int64))
            sketches.append(parity(s) if new else none)
            fines.append(fine_parity(s) if new else none)
            if new:
                seen.add(name)
        lists = []
        for parts in (sketches, fines, words, often):
            at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([none, *parts]))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *lists],
            names=["doc_id", "name", "n", "sketch", "fine", "words", "often"],
        )


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        for c in ("x", "y"):
            slot = _slots(batch.column(c).to_numpy())
            np.bitwise_or.at(bits, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
    words = bits.view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])


def _sets(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """Whole sets, with their names, of the documents that the filter lets pass."""
    some, seen = bits.value, set()
    for batch in batches:
        slot = _slots(batch.column("doc_id").to_numpy())
        asked = batch.filter(pa.array((some[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
        for part in chunks(iter([asked])):
            names, sets = [], []
            for x in sets_of(part.column("text")):
                if (name := identity(x)) not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["name", "elements"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            similar.append(100 * same >= 80 * (len(p) + len(q) - same))
        yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))


def _apart(a: str, b: str):
    """Hamming distance of two sketches; one of twice the other's size is folded first."""

    def folded(x: str, y: str):
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, d: t + d)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows starts, and the number of rows."""
    new = np.zeros(len(columns[0]) + 1, bool)
    new[0] = new[-1] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spanning(roots: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which pairs of roots, taken in the given order, join two sets of roots not joined before: a spanning forest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    chosen = []
    for k in order.tolist():
        x, y = top(int(roots[k, 0])), top(int(roots[k, 1]))
        if x != y:
            up[y] = x
            chosen.append(k)
    return np.asarray(chosen, np.int64)


def _close_in_groups(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each run of equal (word, low, high) whose sizes and sketches are close.

    Rows come sorted by that key and root; a run has about 2 TILE rows.  If low < high,
    only pairs of one row of either tile are made.  forest: of a slice's pairs only a
    spanning forest over the components, closest pairs first, so no more than rows; the
    words of pairs left out follow as rows with a = b = word, which no pair of sets has.
    """
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if held is None or not held.num_rows:
            continue
        word, low, high, tile, name, root, n, least = (held[c].to_numpy() for c in ("word", "low", "high", "tile", "name", "root", "n", "least"))
        edges = _runs(word, low, high)
        ready = held.num_rows if batch is None else int(edges[-2])  # the last run may go on
        if ready:
            edges = edges[edges <= ready]
            size = held.num_rows
            sketch = held["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(size, -1)
            own = _runs(word, low, high, root)
            after = np.repeat(own[1:], np.diff(own))[:ready]  # pairs go from a row to those after its component's
            later = np.repeat(edges[1:], np.diff(edges)) - after
            found, at = [], 0
            while at < ready:  # rows whose pairs are about a million together
                to = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), 1_000_000, "right")) + at)
                k = later[at:to]
                x = np.repeat(np.arange(at, to), k)
                y = np.repeat(after[at:to] - (np.cumsum(k) - k), k) + np.arange(len(x))
                ok = (n[x] * 5 >= n[y] * 4) & (n[y] * 5 >= n[x] * 4) & ((low[x] == high[x]) | (tile[x] != tile[y]))
                x, y = x[ok], y[ok]
                for c in range(0, len(x), 65_536):
                    p, q = x[c : c + 65_536], y[c : c + 65_536]
                    apart = np.bitwise_count(sketch[p] ^ sketch[q]).sum(1, dtype=np.int64)
                    near = apart * 9 <= n[p] + n[q]
                    found.append(np.stack([p[near], q[near], apart[near]], 1))
                at = to
            p, q, apart = (np.concatenate(found) if found else np.zeros((0, 3), np.int64)).T
            p, q = np.where(name[p] < name[q], p, q), np.where(name[p] < name[q], q, p)
            number = np.unique(name, return_inverse=True)[1]
            pair, left = number[p] * size + number[q], np.zeros(0, np.int64)
            if forest:
                chosen = _spanning(np.stack([root[p], root[q]], 1), np.lexsort((pair, apart)))
                left = np.unique(word[p[~np.isin(pair, pair[chosen])]])
                p, q, pair = p[chosen], q[chosen], pair[chosen]
            once = np.unique(pair, return_index=True)[1]
            p, q = p[once], q[once]
            columns = ((name[p], left), (name[q], left), (least[p], left), (least[q], left))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["a", "b", "x", "y"])
            held = held.slice(ready)


def _shared(wide: DataFrame, k: int) -> DataFrame:
    """(members, rows, centre, name, word): the words of slice k that several sets share.

    Members are told by a hash of their names, centre is the smallest of them.  Each
    task emits the words of its own copies of a set, so repeats of (word, name) go first,
    else they cancel out of the hash.  Words met often are told by sums that are made
    partly before the shuffle, and joined with at most HOT_IN_ALL rows.
    """
    by_word, in_slice = Window.partitionBy("word"), F.pmod("word", F.lit(SLICES)) == k
    some = (
        wide.where("size(words) > 0").select("name", F.explode("words").alias("word")).where(in_slice)
        .withColumn("before", F.lag("name").over(by_word.orderBy("name"))).where("before IS NULL OR before < name").drop("before")
        .withColumns(
            {
                "centre": F.min("name").over(by_word), "last": F.max("name").over(by_word),
                "members": F.bit_xor(F.xxhash64("name")).over(by_word), "rows": F.count("*").over(by_word),
            }
        )
    )
    often = wide.where("size(often) > 0").select("name", F.explode("often").alias("word")).where(in_slice).distinct()
    told = often.groupBy("word").agg(
        F.min("name").alias("centre"), F.max("name").alias("last"), F.bit_xor(F.xxhash64("name")).alias("members"), F.count("*").alias("rows")
    )
    return some.unionByName(often.join(F.broadcast(told), "word")).where("centre < last").select("members", "rows", "centre", "name", "word")


def _met(wide: DataFrame) -> DataFrame:
    """(members, rows, centre, name, word): the words that several sets share; of words that the same sets share one.

    Nearly all words have one set only and go within their slice; those shared are written.
    """
    parts = []
    for k in range(SLICES):
        parts.append(keep(_shared(wide, k), "shared"))
        parts[-1].isEmpty()  # until another query ends, Spark holds the last one's plan, and so the slice's shuffle files
        release(wide.sparkSession)
    met = keep(reduce(DataFrame.unionByName, parts).groupBy("members", "rows", "centre", "name").agg(F.min("word").alias("word")), "met")
    forget(*parts)
    return met


def _stars(met: DataFrame, about: DataFrame) -> DataFrame:
    """Close pairs (a, b, x, y) of a group's smallest member and each other one; x, y: a document of either."""
    other = about.select("name", "n", "sketch", "least")
    centre = other.select(*(F.col(c).alias(f"{c}_a") for c in other.columns))
    return (
        met.where("name <> centre").select("centre", "name").distinct().join(other, "name").join(centre, F.col("centre") == F.col("name_a"))
        .where("n_a * 5 >= n * 4 AND n * 5 >= n_a * 4").where(_apart("sketch_a", "sketch") * 9 <= F.col("n_a") + F.col("n"))
        .select(F.col("name_a").alias("a"), F.col("name").alias("b"), F.col("least_a").alias("x"), F.col("least").alias("y"))
    )


def _close_finely(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Those pairs that finer sketches, where both sets have them, allow too.  Only pairs meet them, as they are long."""
    fines = about.where("size(fine) > 0")
    p, q = (fines.select(F.col("name").alias(k), F.col("n").alias(f"n_{k}"), F.col("fine").alias(f"s_{k}")) for k in "ab")
    return (
        pairs.join(p, "a", "left").join(q, "b", "left")
        .where(F.col("n_a").isNull() | F.col("n_b").isNull() | (_apart("s_a", "s_b") * 9 <= F.col("n_a") + F.col("n_b"))).select("a", "b", "x", "y")
    )


def _cross(met: DataFrame, about: DataFrame, roots: DataFrame, forest: bool) -> DataFrame:
    """Distinct close pairs (a, b, x, y) of different components that share a word; see `_close_in_groups` for forest.

    Groups of two sets are left to `_stars`, which has compared them.
    A group's members outside of its largest component are dealt into tiles of about
    TILE rows, those of the largest one into chunks; every pair of tiles, and of a chunk
    and a tile, is a run of its own, so no task holds a whole large group and pairs
    inside the largest component are never made.  Sketches join last, so they are
    shuffled once, and only where a group still has several components.
    """
    labelled = met.where("rows > 2").select("word", "name").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    told = (
        labelled.groupBy("word", "root").agg(F.count("*").alias("n")).groupBy("word")
        .agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")).where("all > most")
        .select("word", "main", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("tiles"), F.ceil(F.col("most") / TILE).cast("int").alias("chunks"))
    )
    is_main = F.col("root") == F.col("main")
    dealt = labelled.join(told, "word").withColumn("tile", F.when(is_main, -1 - F.pmod(F.xxhash64("name"), "chunks")).otherwise(F.pmod(F.xxhash64("name"), "tiles")).cast("int"))
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    key = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    with_main = F.transform(tiles, lambda t: key(F.col("tile"), t))
    with_tiles = F.transform(tiles, lambda t: key(F.least("tile", t), F.greatest("tile", t)))
    with_chunks = F.transform(F.sequence(F.lit(1), F.col("chunks")), lambda c: key(-c, F.col("tile")))
    keys = ["word", "low", "high"]
    return (
        dealt.withColumn("run", F.explode(F.when(is_main, with_main).otherwise(F.concat(with_tiles, with_chunks))))
        .select("word", "run.low", "run.high", "tile", "name", "root").join(about.drop("fine"), "name")
        .select(*keys, "tile", "name", "root", "n", "least", "sketch").repartition(*keys).sortWithinPartitions(*keys, "root")
        .mapInArrow(lambda it: _close_in_groups(it, forest), "a long, b long, x long, y long").dropDuplicates(["a", "b"])
    )


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of set names whose whole sets are similar; x, y: documents that have them.

    A bit filter of fixed size (1 MB) keeps most documents without a pair from being
    set up or shuffled; the join on the sets' names makes the result exact.
    """
    sc = docs.sparkSession.sparkContext
    words = pairs.select("x", "y").mapInArrow(_filter_words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    sent = sc.broadcast(bits.view(np.uint8))
    sets = keep(docs.mapInArrow(lambda it: _sets(it, sent), "name long, elements binary").dropDuplicates(["name"]), "sets")
    links = keep(
        pairs.select("a", "b").join(sets.select(F.col("name").alias("b"), F.col("elements").alias("y")), "b")
        .join(sets.select(F.col("name").alias("a"), F.col("elements").alias("x")), "a")
        .select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"),
        "links",
    )
    sent.unpersist()
    forget(sets)
    release(docs.sparkSession)
    return links


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(described, links, roots): per document its set's name and size; links that connect all similar sets; (node, root) of linked names.

    docs: doc_id, text.  A null text is empty; rows with a null doc_id are left out, and a
    doc_id that repeats is taken as one document per row.  Two names are linked only if
    their sets' Jaccard similarity is 4/5 or more; sets that are similar are in the
    same component of links.  Equal sets have the same name.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hot = spark.sparkContext.broadcast(frequent_words(docs))
    wide = keep(
        docs.mapInArrow(
            lambda it: _describe(it, hot), "doc_id long, name long, n long, sketch array<long>, fine array<long>, words array<long>, often array<long>"
        ),
        "wide",
    )
    described = keep(wide.select("doc_id", "name", "n"), "described")
    met = _met(wide)
    about = keep(
        wide.where("n > 0").groupBy("name")
        .agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), *(F.max_by(c, F.size("sketch")).alias(c) for c in ("sketch", "fine")))
        .join(met.select("name").distinct(), "name", "left_semi"),
        "about",
    )
    forget(wide)
    release(spark)
    stars = keep(_close_finely(_stars(met, about), about), "stars")
    links = _verify(stars, docs)
    roots = components(links, "a", "b")
    forget(stars)
    again = met
    for forest in (True, False):
        close = keep(_close_finely(_cross(again, about, roots, forest), about), "close")
        pairs = close.where("a <> b")
        if not pairs.isEmpty():
            found = _verify(pairs, docs)
            links, before = links.unionByName(found), roots
            roots = components(found.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
            forget(before)
        if forest:
            left = keep(close.where("a = b").select(F.col("a").alias("word")), "left")
            again = met.join(left, "word", "left_semi")
        forget(close)
        if left.isEmpty():  # the forest had every close pair
            break
    forget(left)
    forget(met, about)
    return described, links, roots


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see `similar_sets`.

    component_id is the smallest doc_id reachable by links.  Equal non-empty sets are
    linked; a text without words has 0 shingles and is a component of its own.  A row
    with a null doc_id has its size and a null component.  Columns other than doc_id and
    text are ignored.  An empty table gives no rows.
    """
    described, _, roots = similar_sets(docs)
    some = described.where("n > 0").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    # written, so that the join with a component of very many documents can be split
    ids = keep(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    out = some.join(ids, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    unnamed = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    unnamed = unnamed.mapInArrow(_sizes, "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long"))
    return out.unionByName(none).unionByName(unnamed)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sizes = [len(s) for s in sets_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_shingles"])
