"""Benchmark decontamination by CGK embedding and bit-sampling LSH, verified exactly.

A document holds a benchmark item when some run of its words is within EDITS of the
item's length in word edits (insertions, deletions, substitutions).

1. Length classes: items whose lengths differ by about 5 % share a class.  A run that
   starts at word p and is within k edits of an item of L words has at least L - k of
   the item's words among words p to p + L - 1, and lacks at most k of the item's rare
   words; places where too few words belong to the class's vocabulary, or to its rare
   words (those of few items), are passed over.  These bounds lose nothing.
2. At the places left, an item-sized window is embedded by the random walk of
   Chakraborty, Goldenberg and Koucky (2016): step t copies the word at the walk's
   place and moves on or not by a random bit of (t, word).  Word edit distance becomes
   Hamming distance.  Tables of bit-sampling LSH each compare a few positions of the
   embedding; embeddings are repeated until made edits of the items, at the largest
   distance allowed, are found with RECALL, measured on edits that the choice has not
   seen.  A class that MOST_WALKS embeddings don't bring there is searched without LSH:
   all its items are verified at every place left.
3. Candidates are verified: the least edit distance of the item to any run of words
   around the window.

Items of under LEAST_WORDS words, which an edit would make another question, are found
where all their words stand in a row, without LSH.

Items are taken in blocks of at most BLOCK items and BLOCK_BYTES bytes (one longer item
is a block of its own), so that what is sent to the tasks is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import forget, keep
from .textkit import ALNUM, Lookup, Words, chunks, grams, mix

EDITS = 0.2
LEAST_WORDS = 8  # shorter items are searched verbatim
RECALL = 0.97
SAMPLED, TABLES, MOST_WALKS = 2, 12, 24  # positions a table compares, tables of an embedding, most embeddings
BLOCK, BLOCK_BYTES = 20_000, 8 << 20
PAIRS = 1 << 20  # window and item pairs compared at once where LSH is not used
RARE = 0.03  # a word of at most this share of the items is rare
_NOTHING = np.uint64(0xA0761D6478BD642F)  # beyond a window's end
MATCHES = "array<struct<item_id: long, edits: int, first_word: long, n_words: int>>"


def allowed(n: int) -> int:
    return int(EDITS * n)


def walk(strings: np.ndarray, seed: int, positions: np.ndarray) -> np.ndarray:
    """Columns `positions` (ascending) of the CGK embeddings of the rows of `strings`."""
    n, size = strings.shape
    padded = np.concatenate([strings, np.full((n, 1), _NOTHING)], 1)
    flat, row = padded.ravel(), np.arange(n) * (size + 1)
    at = np.zeros(n, np.int64)
    out = np.empty((n, len(positions)), np.uint64)
    wanted = {int(t): k for k, t in enumerate(positions)}
    for t in range(int(positions[-1]) + 1):
        here = flat[row + at]
        if t in wanted:
            out[:, wanted[t]] = here
        step = (here * np.uint64((2 * (seed * 100_003 + t) + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)
        at += step.astype(np.int64)
        np.minimum(at, size, out=at)
    return out


class Tables:
    """The positions that the tables of each embedding sample, for windows of `size` words."""

    def __init__(self, size: int):
        self.size = size
        self.walks: list[tuple[np.ndarray, np.ndarray]] = []  # sampled positions, ascending; their columns by table
        for seed in range(MOST_WALKS):
            rng = np.random.default_rng(1000 * size + seed)
            picked = rng.integers(0, max(1, 2 * size - size // 4), (TABLES, SAMPLED))
            positions, columns = np.unique(picked, return_inverse=True)
            self.walks.append((positions, columns.reshape(TABLES, SAMPLED)))

    def keys(self, strings: np.ndarray, seed: int) -> np.ndarray:
        """One key a string and table."""
        positions, columns = self.walks[seed]
        symbols = walk(strings, seed, positions)
        key = np.full((len(strings), TABLES), np.uint64(seed + 1))
        for k in range(SAMPLED):
            key = key * np.uint64(0xD6E8FEB86659FD93) + symbols[:, columns[:, k]]
        return mix(key + np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cut(words: np.ndarray, size: int) -> np.ndarray:
    """Exactly `size` words, with nothing after the last."""
    out = np.full(size, _NOTHING)
    out[: min(size, len(words))] = words[:size]
    return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        k, at = int(rng.integers(3)), int(rng.integers(len(out)))
        new = int(rng.integers(1 << 62))
        if k == 0:
            out[at] = new
        elif k == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def fit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(least edits, end) of the item against any run of words of the region."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for k, w in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != np.uint64(w)))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Class:
    """The items of one length class: windows of `size` words, LSH tables over their embeddings."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.items = ids, items
        lengths = [len(x) for x in items]
        self.size, self.need = max(lengths), min(n - allowed(n) for n in lengths)
        self.tables = Tables(min(lengths))
        strings = np.stack([cut(x, self.tables.size) for x in items])
        self.walks = self._walks_for_recall()  # 0: no LSH
        owner = np.tile(np.arange(len(items)), TABLES)
        self.index = []
        for walk_ in range(self.walks):
            k = self.tables.keys(strings, walk_).T.ravel()
            order = np.argsort(k, kind="stable")
            self.index.append((k[order], owner[order]))

    def _walks_for_recall(self) -> int:
        """How many embeddings find RECALL of edits at the largest distance allowed; 0: more than MOST_WALKS."""
        rng = np.random.default_rng(len(self.items))
        asked = [self.items[k] for k in rng.permutation(len(self.items))[:64]]
        pairs = [(x, edited(x, allowed(len(x)), rng)) for x in asked for _ in range(max(2, 256 // len(asked)))]
        a = np.stack([cut(x, self.tables.size) for x, _ in pairs])
        b = np.stack([cut(y, self.tables.size) for _, y in pairs])
        found = np.zeros(len(pairs), bool)
        chosen = np.arange(len(pairs)) % 2 == 0  # the others tell whether the choice holds
        for s in range(MOST_WALKS):
            found |= (self.tables.keys(a, s) == self.tables.keys(b, s)).any(1)
            if found[chosen].mean() >= RECALL and found[~chosen].mean() >= RECALL:
                return s + 1
        return 0

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a table's key, each once; without LSH all pairs."""
        if not self.walks:
            return np.repeat(np.arange(len(windows)), len(self.items)), np.tile(np.arange(len(self.items)), len(windows))
        pairs = []
        for s, (keys, owner) in enumerate(self.index):
            mine = self.tables.keys(windows, s).ravel()
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = high - low
            hit = np.repeat(np.arange(len(mine)) // TABLES, n)
            which = owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs.append(np.unique(hit * len(self.items) + which))
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.items), pairs % len(self.items)


class Searcher:
    """Finds the items of one block in whole documents."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = Words(pc.utf8_lower(pa.array(texts, pa.string())), ALNUM)
        items: dict[tuple, list[int]] = {}
        brief: dict[tuple, set[int]] = {}
        for k, i in enumerate(ids):
            w = words.hash[words.first[k] : words.first[k + 1]]
            if len(w) >= LEAST_WORDS:
                items.setdefault(tuple(w.tolist()), []).append(i)
            elif len(w):
                brief.setdefault(tuple(w.tolist()), set()).add(i)
        # items under LEAST_WORDS words, by their number of words: hashes of the whole, and the ids
        self.brief = []
        for n in sorted({len(w) for w in brief}):
            by_hash = sorted((int(grams(np.array(w, np.uint64), n)[0]), sorted(v)) for w, v in brief.items() if len(w) == n)
            self.brief.append((n, Lookup(np.array([h for h, _ in by_hash], np.uint64)), [v for _, v in by_hash]))
        self.same = {min(v): sorted(set(v)) for v in items.values()}  # items of equal words are searched once
        ordered = sorted((len(k), min(v), k) for k, v in items.items())
        groups: list[list] = []
        for n, i, w in ordered:
            if groups and n <= groups[-1][0][0] * 1.05:
                groups[-1].append((n, i, w))
            else:
                groups.append([(n, i, w)])
        self.classes = [Class([i for _, i, _ in g], [np.array(w, np.uint64) for *_, w in g]) for g in groups]
        # per word of any item, a row of bits: the classes whose items have it
        pairs = {(w, c) for c, g in enumerate(groups) for *_, ws in g for w in ws}
        known = np.array(sorted({w for w, _ in pairs}), np.uint64)
        self.lookup = Lookup(known)
        self.has = np.zeros((len(self.classes), len(known) + 1), bool)  # the last column: a word of no item
        where = {w: k for k, w in enumerate(known.tolist())}
        for w, c in pairs:
            self.has[c, where[w]] = True
        times = np.bincount(np.array([where[w] for ws in items for w in set(ws)], np.int64), minlength=len(known))
        self.rare = np.append(times <= max(2, RARE * len(items)), False)
        for cls in self.classes:
            cls.need_rare = min(int(self.rare[[where[w] for w in x.tolist()]].sum()) - allowed(len(x)) for x in cls.items)

    def search(self, column: pa.Array) -> list[list[dict]]:
        words = Words(pc.utf8_lower(column), ALNUM)
        h, n = words.hash, len(words)
        docs = len(words.first) - 1
        out: list[list[dict]] = [[] for _ in range(docs)]
        for size, lookup, owners in self.brief:
            at = lookup(grams(h, size))
            hit = np.flatnonzero(at >= 0)
            hit = hit[words.doc[hit] == words.doc[hit + size - 1]]
            _, first = np.unique(words.doc[hit] * len(owners) + at[hit], return_index=True)  # the first place of each
            for k in hit[first].tolist():
                d = int(words.doc[k])
                out[d] += [{"item_id": i, "edits": 0, "first_word": k - int(words.first[d]), "n_words": size} for i in owners[at[k]]]
        at = self.lookup(h)
        rare = np.flatnonzero(self.rare[at])
        for c, cls in enumerate(self.classes):
            near = self._near(rare[self.has[c][at[rare]]], cls, n)
            if near is not None and not near.any():
                continue
            inside = np.concatenate([[0], np.cumsum(self.has[c][at], dtype=np.int32)])
            start = np.arange(n) if near is None else np.flatnonzero(near)
            limit = words.first[words.doc[start] + 1]  # windows end with their document
            ok = inside[np.minimum(start + cls.size, limit)] - inside[start] >= cls.need
            start, limit = start[ok], limit[ok]
            found: dict[tuple[int, int], list[int]] = {}
            step = 4096 if cls.walks else max(1, PAIRS // len(cls.items))
            for a in range(0, len(start), step):
                s, e = start[a : a + step], limit[a : a + step]
                grid = s[:, None] + np.arange(cls.tables.size)
                windows = np.where(grid < e[:, None], h[np.minimum(grid, n - 1)], _NOTHING)
                for w, item in zip(*(x.tolist() for x in cls.candidates(windows)), strict=True):
                    found.setdefault((int(words.doc[s[w]]), item), []).append(int(s[w]))
            for (d, item), places in found.items():
                best = self._verify(h, int(words.first[d]), int(words.first[d + 1]), cls.items[item], places)
                if best:
                    out[d] += [{"item_id": i, "edits": best[0], "first_word": best[1], "n_words": best[2]} for i in self.same[cls.ids[item]]]
        return [sorted(x, key=lambda m: m["item_id"]) for x in out]

    @staticmethod
    def _near(places: np.ndarray, cls: Class, n: int) -> np.ndarray | None:
        """Where a window of the class has enough rare words, given the places of those; None: anywhere may."""
        m = cls.need_rare
        if m <= 0:
            return None
        last, first = places[m - 1 :], places[: len(places) - m + 1]
        if not len(last):
            return np.zeros(n, bool)
        close = last - first < cls.size
        turn = np.zeros(n + 1, np.int32)
        np.add.at(turn, np.maximum(last[close] - cls.size + 1, 0), 1)
        np.add.at(turn, first[close] + 1, -1)
        return np.cumsum(turn[:n]) > 0

    @staticmethod
    def _verify(h: np.ndarray, first: int, last: int, item: np.ndarray, places: list[int]) -> tuple[int, int, int] | None:
        """(edits, first word in the document, words) of the best run around the places, if within the limit."""
        k, best = allowed(len(item)), None
        a = 0
        while a < len(places):
            b = a
            while b + 1 < len(places) and places[b + 1] - places[b] <= len(item) + 2 * k:
                b += 1
            low, high = max(first, places[a] - k), min(last, places[b] + len(item) + k)
            a = b + 1
            if int(np.isin(h[low:high], item).sum()) < len(item) - k:
                continue
            edits, end = fit_distance(item, h[low:high])
            if edits <= k and (best is None or edits < best[0]):
                _, back = fit_distance(item[::-1], h[low : low + end][::-1])
                best = (edits, low + end - back - first, back)
        return best


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of docs with `matches`: item_id, edits, first_word, n_words of each item it holds, by item_id.

    docs: any columns with text (null: empty, no match); a column matches is replaced.
    benchmark: item_id, text; a null text, or one without words, matches nothing, one of
    under LEAST_WORDS words only itself; a null item_id is left out; items of equal words all match.  Words are runs
    of letters, digits and characters beyond ASCII, lower-cased in every script.  Of several runs
    the one with fewest edits is told, the first of equals.  Repeated documents are
    searched each.  An empty benchmark gives empty arrays.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "matches"]
    kind = T.DataType.fromDDL(MATCHES)
    out = docs.select(*columns, F.array().cast(kind).alias("matches"))
    schema = docs.select(*columns).schema.add("matches", kind)
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-size[0] // BLOCK), -(-(size[1] or 0) // BLOCK_BYTES))
    held = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about BLOCK rows, BLOCK_BYTES bytes
        searcher = spark.sparkContext.broadcast(Searcher([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            at = len(columns)
            for batch in chunks(batches):
                found = searcher.value.search(batch.column("text"))
                both = [old + new for old, new in zip(batch.column(at).to_pylist(), found, strict=True)]
                both = pa.array([sorted(x, key=lambda m: m["item_id"]) for x in both], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), both)

        out = out.mapInArrow(run, schema)
        if k + 1 < blocks:  # the next block is searched by a job of its own, so that one block's tables are held at a time
            stored = keep(out, f"block{k}")
            searcher.destroy()
            forget(*(x for x in [held] if x is not None))
            out = held = stored
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words), one row a document and item it holds; see `find_items`.

    Documents that hold nothing, and a null or empty text, have no row; a document row that
    repeats has its rows each time; an empty table gives no rows.
    """
    found = find_items(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
