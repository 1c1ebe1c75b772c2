"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The lattice of a text has an edge for every piece of the vocabulary, scored as the
model file scores it, and byte pieces for characters that no piece has (scored
UNKNOWN below the least score).  Forward Viterbi scores are exact heuristics for a
backward A-star search, which yields segmentations in order of falling score.

A text is cut into parts where no piece can cross: before a run of word marks, and
around characters that are in no piece; a part of more than LONG bytes, such as a text in
a script without spaces, is cut further where no piece of the vocabulary spans the
place.  The lattice of a text is then a chain of
independent ones.  Viterbi and its backward twin run in numpy over all new parts of
a slice at once, which also gives every part's loss to its second-best segmentation.
The N best segmentations of a text change only the parts with the N - 1 least losses,
so A-star runs on those parts alone, and the texts' N best are merged exactly.  A part
of more than LONG bytes that can't be cut (one letter over and over) is searched by
dynamic programming that keeps the N best at every place, which needs some 50 bytes a
character, where A-star's queue has no such bound.

Ids are those of highest summed score.  They need not be what the library's byte-pair
encoder gives, which merges greedily.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Lookup, chunks, mix, raw, spelt

MARK = "▁"
UNKNOWN = 10.0  # what a character without a piece costs, below the least score
MEMO_BYTES = 12 << 20  # what a process remembers of parts met before, in each of two generations
ENTRY = 320  # bytes of a remembered part besides its ids
LONG, LEAST = 2048, 96  # bytes from which a part is cut further, and least characters of what it is cut into
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces and scores of a SentencePiece model file (identity normalisation, dummy prefix)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(k) for k in range(n)]
        self.score = np.array([sp.get_score(k) for k in range(n)])
        special = [sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) for k in range(n)]
        self.ids = {p: k for k, p in enumerate(self.text) if not special[k]}
        self.bytes = {int(self.text[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.unknown = float(min(self.score[k] for k in self.ids.values())) - UNKNOWN
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over a word's start")
        known = set("".join(self.ids))
        self.known = known
        alone = "".join(re.escape(c) for c in ("\n", "\t", "\r") if c not in known)
        self.parts = re.compile(rf"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]" if alone else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in "\n\t\r" if c not in known]] = True
        # every beginning of a piece, so that a search stops where no piece goes on
        prefixes = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)})
        keys = self._hash(prefixes)
        order = np.argsort(keys)
        self.lookup = Lookup(keys[order])
        self.by_key = np.array([self.ids.get(p, -1) for p in prefixes])[order]
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else b"" if special[k] else p.replace(MARK, " ").encode() for k, p in enumerate(self.text)]
        self.raw, self.raw_size = raw, np.array([len(r) for r in raw])
        self.raw_flat, self.raw_first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.raw_size) - self.raw_size

    def _hash(self, strings: list[str]) -> np.ndarray:
        """The running hash of whole strings, as `_solve` makes it of substrings."""
        n = max(map(len, strings))
        chars = np.frombuffer("".join(s.ljust(n, "\0") for s in strings).encode("utf-32-le"), np.uint32).reshape(-1, n)
        size, h = np.array([len(s) for s in strings]), np.zeros(len(strings), np.uint64)
        for k in range(n):
            h = np.where(k < size, h * _BASE + mix(chars[:, k].astype(np.uint64)), h)
        return mix(h)

    def normalised(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def spelt(self, char: str) -> list[int]:
        """Byte pieces of a character that no piece has."""
        return [self.bytes[b] for b in char.encode()]

    def decode(self, ids) -> str:
        """The text of a segmentation; the dummy prefix is taken off."""
        text = b"".join([self.raw[k] for k in ids]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    # one part ----------------------------------------------------------------------

    def edges(self, part: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the lattice's edges that end at a place."""
        out = []
        for start in range(max(0, end - self.longest), end):
            k = self.ids.get(part[start:end])
            if k is not None:
                out.append((start, float(self.score[k]), (k,)))
            elif end - start == 1:
                out.append((start, self.unknown, tuple(self.spelt(part[start:end]))))
        return out

    def forward(self, part: str) -> list[float]:
        best = [0.0] + [-np.inf] * len(part)
        for end in range(1, len(part) + 1):
            best[end] = max(best[start] + score for start, score, _ in self.edges(part, end))
        return best

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """n segmentations (score, ids) of highest score, best first: backward A-star.

        As the forward scores are exact, no entry is taken up that is not on one of the
        results; of equal bounds the one nearest to the start goes first, so that ties
        are not explored side by side.
        """
        best = self.forward(part)
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], len(part), 0, 0.0, None)]
        made = 0
        found: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(found) < n:
            _, at, _, done, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    own, path = path
                    ids += own
                found.append((done, tuple(ids)))
                continue
            for start, score, own in self.edges(part, at):
                made += 1
                heapq.heappush(queue, (-(best[start] + score + done), start, made, score + done, (own, path)))
        return sorted(found, key=lambda f: (-f[0], f[1]))

    def ranked(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """As `n_best`, for a long part: the n best ways to every place, each told by its last edge and the way before it."""
        size = len(part)
        score = np.full((size + 1, n), -np.inf)
        length, before = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int8)
        score[0, 0] = 0.0
        for end in range(1, size + 1):
            ways = [(s + own, end - start, k) for start, own, _ in self.edges(part, end) for k, s in enumerate(score[start].tolist()) if s > -np.inf]
            for k, (s, edge, way) in enumerate(heapq.nlargest(n, ways)):
                score[end, k], length[end, k], before[end, k] = s, edge, way
        found = []
        for k, s in enumerate(score[size].tolist()):
            if s > -np.inf:
                ids, end, way = [], size, k
                while end:
                    edge, way, last = int(length[end, way]), int(before[end, way]), end
                    end = last - edge
                    own = self.ids.get(part[end:last])
                    ids.append((own,) if own is not None else tuple(self.spelt(part[end:last])))
                found.append((s, tuple(i for own in reversed(ids) for i in own)))
        return found

    def places(self, part: str) -> np.ndarray:
        """Places, LEAST characters or more apart, that no piece of a part spans."""
        n = len(part)
        coded = mix(np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64))
        spans = np.zeros(n + 1, np.int64)
        for a in range(0, n, 1 << 16):
            live = np.arange(a, min(a + (1 << 16), n))
            h = np.zeros(len(live), np.uint64)
            for k in range(self.longest):
                h = h * _BASE + coded[live + k]
                at = self.lookup(mix(h))
                known = at >= 0
                live, h, at = live[known], h[known], at[known]
                if k:
                    hit = live[self.by_key[at] >= 0]
                    np.add.at(spans, hit + 1, 1)
                    np.add.at(spans, hit + k + 1, -1)
                inside = live + k + 1 < n
                live, h = live[inside], h[inside]
                if not len(live):
                    break
        free = np.flatnonzero(np.cumsum(spans[:n]) == 0)
        out, last = [], 0
        while len(free) and (k := int(np.searchsorted(free, last + LEAST))) < len(free):
            last = int(free[k])
            out.append(last)
        return np.array(out, np.int64)

    # many parts --------------------------------------------------------------------

    def solve(self, parts: list[str]) -> list[tuple[bytes, float, float]]:
        """Per part: the ids of a best segmentation (int32 bytes), its score, and the loss to the second best."""
        out: list = [None] * len(parts)
        size = np.array([len(p) for p in parts])
        # lengths are rounded up, so that few groups remain; what lies past a part's end is in no piece
        rounded = np.where(size <= 16, -(-size // 2) * 2, np.where(size <= 64, -(-size // 8) * 8, -(-size // 64) * 64))
        for n in np.unique(rounded).tolist():
            members = np.flatnonzero(rounded == n)
            step = max(1, 500_000 // (n * min(n, self.longest)))
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for k, r in zip(some.tolist(), self._solve([parts[k] for k in some], size[some], n), strict=True):
                    out[k] = r
        return out

    def _solve(self, parts: list[str], size: np.ndarray, n: int) -> Iterator[tuple[bytes, float, float]]:
        w, reach = len(parts), min(n, self.longest)
        chars = np.frombuffer("".join(p.ljust(n, "\0") for p in parts).encode("utf-32-le"), np.uint32).reshape(w, n)
        coded = np.ascontiguousarray(mix(chars.astype(np.uint64)).T)
        # edge (start, length - 1): its piece, -1 for none, -2 for a character spelt in bytes; and its score
        ids, scores = np.full((n, reach, w), -1, np.int32), np.full((n, reach, w), -np.inf)
        for start in range(n):
            ids[start, 0], scores[start, 0] = -2, self.unknown
            live, h = np.arange(w), np.zeros(w, np.uint64)
            for k in range(min(reach, n - start)):
                h = h * _BASE + coded[start + k, live]
                at = self.lookup(mix(h))
                known = at >= 0
                live, h, at = live[known], h[known], at[known]
                if not len(live):
                    break
                piece = self.by_key[at]
                hit = piece >= 0
                ids[start, k, live[hit]] = piece[hit]
                scores[start, k, live[hit]] = self.score[piece[hit]]
        rows = np.arange(w)
        forward, back = np.full((n + 1, w), -np.inf), np.zeros((n + 1, w), np.int64)
        forward[0] = 0
        for end in range(1, n + 1):
            lengths = np.arange(min(end, reach))
            through = forward[end - 1 - lengths] + scores[end - 1 - lengths, lengths]
            back[end] = through.argmax(0)
            forward[end] = through[back[end], rows]
        behind = np.full((n + 1, w), -np.inf)
        behind[size, rows] = 0
        best = np.zeros((n, reach, w), bool)
        for start in range(n - 1, -1, -1):
            lengths = np.arange(min(reach, n - start))
            behind[start] = np.maximum(behind[start], (scores[start, lengths] + behind[start + 1 + lengths]).max(0))
        total = forward[size, rows]
        at, steps = size.copy(), []
        while (live := np.flatnonzero(at > 0)).size:
            k = back[at[live], live]
            start = at[live] - 1 - k
            best[start, k, live] = True
            step = np.full(w, -1, np.int32)
            step[live] = ids[start, k, live]
            steps.append(step)
            at[live] = start
        # every segmentation but the best has an edge that is not on it
        second = np.full(w, -np.inf)
        for start in range(n):
            lengths = np.arange(min(reach, n - start))
            through = forward[start] + scores[start, lengths] + behind[start + 1 + lengths]
            second = np.maximum(second, np.where(best[start, lengths], -np.inf, through).max(0))
        found = np.stack(steps[::-1], 1)
        flat = found[found != -1]
        offsets = np.concatenate([[0], np.cumsum((found != -1).sum(1))]).tolist()
        data = flat.tobytes()
        spelt = (found == -2).any(1).tolist()
        for r, (score, lost) in enumerate(zip(total.tolist(), (total - second).tolist(), strict=True)):
            own = data[4 * offsets[r] : 4 * offsets[r + 1]]
            if spelt[r]:
                place, whole = 0, []
                for k in np.frombuffer(own, np.int32).tolist():
                    whole += [k] if k >= 0 else self.spelt(parts[r][place])
                    place += len(self.text[k]) if k >= 0 else 1
                own = np.array(whole, np.int32).tobytes()
            yield own, score, lost


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, made once a process."""
    return Vocabulary(path)


def cut(column: pa.Array, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of texts, found over their bytes: (bytes, starts, ends, whether a text's first, index of each text's first part).

    A part is a run of spaces with what follows, what follows a lone character, or one;
    before a text's first part stands the dummy prefix.  A text that starts with a lone
    character has an empty part for the prefix first.
    """
    data, at = raw(column)
    n = len(data)
    space, lone = data == 0x20, alone[data]
    new = lone.copy()
    new[1:] |= (space[1:] & ~space[:-1]) | lone[:-1]
    first = at[:-1][np.diff(at) > 0]
    new[first] = True
    start = np.flatnonzero(new)
    leads = np.zeros(len(start), bool)
    leads[np.searchsorted(start, first)] = True
    # the prefix alone, where a lone character comes first
    empty = np.flatnonzero(leads & lone[start])
    end = np.append(start[1:], n)
    end = np.insert(end, empty, start[empty])
    begins = np.insert(leads, empty, True)
    start = np.insert(start, empty, start[empty])
    begins[empty + np.arange(len(empty)) + 1] = False
    return data, start, end, begins, np.searchsorted(start, at, "left")


class Segmenter:
    """N-best segmentations of whole texts; remembers parts met before, within MEMO_BYTES a generation."""

    def __init__(self, path: str, n: int):
        self.vocabulary, self.n = vocabulary(path), n
        self.young: dict[int, tuple[bytes, float, float]] = {}
        self.old: dict[int, tuple[bytes, float, float]] = {}
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.held = self.held_searched = 0

    def _alternatives(self, part: str, solved: tuple[bytes, float, float]) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of a part's other segmentations, least loss first."""
        found = self.searched.get(part)
        if found is None:
            best = tuple(np.frombuffer(solved[0], np.int32).tolist())
            ranked = self.vocabulary.n_best(part, self.n) if len(part) <= LONG else self.vocabulary.ranked(part, self.n)
            found = [(solved[1] - s, ids) for s, ids in ranked if ids != best][: self.n - 1]
            if self.held_searched > MEMO_BYTES:
                self.searched, self.held_searched = {}, 0
            self.searched[part] = found
            self.held_searched += ENTRY + 4 * len(part) + sum(ENTRY + 8 * len(ids) for _, ids in found)
        return found

    def _solved(self, parts: list[str]) -> Iterator[tuple[bytes, float, float]]:
        """As `Vocabulary.solve`; long parts by the N best of every place."""
        v = self.vocabulary
        short = iter(v.solve([p for p in parts if len(p) <= LONG]))
        for part in parts:
            if len(part) <= LONG:
                yield next(short)
                continue
            best, *other = v.ranked(part, max(2, self.n))
            yield np.array(best[1], np.int32).tobytes(), best[0], best[0] - other[0][0] if other else np.inf

    def _cut(self, column: pa.Array):
        """As `cut`; parts of more than LONG bytes are cut further where no piece can cross."""
        data, start, end, begins, first_part = cut(column, self.vocabulary.alone)
        more = []
        for k in np.flatnonzero(end - start > LONG).tolist():
            own = data[start[k] : end[k]]
            chars = np.flatnonzero((own & 0xC0) != 0x80)  # where each character starts
            lead = int(begins[k])  # the dummy prefix stands before the first one
            at = self.vocabulary.places((MARK if lead else "") + own.tobytes().decode().replace(" ", MARK)) - lead
            more += [(k, start[k] + chars[at[at > 0]])]
        if more:
            n = np.zeros(len(start), np.int64)
            n[[k for k, _ in more]] = [len(at) for _, at in more]
            new = np.concatenate([at for _, at in more])
            owner = np.repeat([k for k, _ in more], [len(at) for _, at in more])
            start, begins = np.insert(start, owner + 1, new), np.insert(begins, owner + 1, False)
            end = np.insert(end, owner, new)
            first_part = first_part + np.concatenate([[0], np.cumsum(n)])[first_part]
        return data, start, end, begins, first_part

    def run(self, column: pa.Array):
        """(ids of all texts, n + 1 offsets of the texts, and per text its n best).

        The n best are (score, [(part number, ids put there instead)]), best first.
        """
        v = self.vocabulary
        data, start, end, begins, first_part = self._cut(column)
        key = mix(spelt(data, start, end) + (end - start).astype(np.uint64) * np.uint64(2) + begins.astype(np.uint64))
        found, at, index = np.unique(key, return_index=True, return_inverse=True)
        text = data.tobytes()
        named = lambda k: (MARK if begins[k] else "") + text[start[k] : end[k]].decode().replace(" ", MARK)
        known, new = [], []
        young, old = self.young, self.old
        for j, h in enumerate(found.tolist()):
            r = young.get(h)
            if r is None:
                r = old.get(h)
                if r is None:
                    new.append(j)
                else:
                    young[h] = r
                    self.held += ENTRY + len(r[0])
            known.append(r)
        for a in range(0, len(new), 50_000):
            for j, r in zip(new[a : a + 50_000], self._solved([named(at[j]) for j in new[a : a + 50_000]]), strict=True):
                known[j] = young[int(found[j])] = r
                self.held += ENTRY + len(r[0])
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = young, {}, 0
        size = np.array([len(r[0]) >> 2 for r in known], np.int64)
        flat = np.frombuffer(b"".join([r[0] for r in known]), np.int32)
        base = np.cumsum(size) - size
        scores, losses = (np.array([r[k] for r in known]) for k in (1, 2))
        n = size[index]
        offsets = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(base[index] - offsets[:-1], n) + np.arange(offsets[-1])]
        by_part, lost = scores[index], losses[index]
        out = []
        for a, b in zip(first_part[:-1].tolist(), first_part[1:].tolist(), strict=True):
            loss = lost[a:b]
            few = min(self.n - 1, b - a)
            if few and b - a > few:
                most = np.partition(loss, few - 1)[few - 1]
                # of equal losses the first places, so that the choice is a fixed one
                near = np.concatenate([np.flatnonzero(loss < most), np.flatnonzero(loss == most)[:few]])[:few]
            else:
                near = np.arange(few)
            best: list[tuple[float, list[tuple[int, tuple[int, ...]]]]] = [(0.0, [])]
            for k in sorted(int(k) for k in near if np.isfinite(loss[k])):
                options = self._alternatives(named(a + k), known[index[a + k]])
                grown = best + [(lost_ + more, [*changes, (k, other)]) for lost_, changes in best for more, other in options]
                best = sorted(grown, key=lambda x: (x[0], x[1]))[: self.n]
            score = float(by_part[a:b].sum())
            out.append([(score - lost_, changes) for lost_, changes in best])
        return ids, offsets[first_part], out

    def __call__(self, texts: list[str]):
        """Per text: best ids, and its n best."""
        ids, at, best = self.run(pa.array(texts, pa.string()))
        return [(ids[a:b], x) for a, b, x in zip(at[:-1].tolist(), at[1:].tolist(), best, strict=True)]

    def lossless(self, column: pa.Array, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each text's ids decode to its bytes, the dummy prefix before them."""
        v = self.vocabulary
        data, place = raw(column)
        size = v.raw_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        decoded = v.raw_flat[np.repeat(v.raw_first[ids] - ends[:-1], size) + np.arange(ends[-1])]
        got, length = ends[at], np.diff(place)
        same = np.diff(got) == length + (length > 0)
        for k in np.flatnonzero(same & (length > 0)).tolist():
            same[k] = decoded[got[k]] == 0x20 and np.array_equal(decoded[got[k] + 1 : got[k + 1]], data[place[k] : place[k + 1]])
        return same


RESULT = "n_pieces long, ids binary, best_score double, n_best array<struct<score: double, changes: array<struct<part: int, ids: array<int>>>>>, lossless boolean"


def encode_texts(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """Every row of docs with the n best segmentations of its whole text.

    docs: any columns with text; a null text is empty: no pieces, score 0.  Columns of
    the result's names are replaced: n_pieces, ids (the best segmentation, little-endian
    int32), best_score, n_best (scores and the parts that differ from the best), lossless
    (the ids decode to the text).  Repeated rows are encoded each; an empty table gives
    no rows.
    """
    names = ("n_pieces", "ids", "best_score", "n_best", "lossless")
    columns = [c for c in docs.columns if c not in names]
    base = docs.select(*columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segmenter(path, n)  # its memory ends with the task
        kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("part", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
        for batch in chunks(batches, most=1_000_000):
            ids, at, best = segment.run(batch.column("text"))
            ranked = [[{"score": s, "changes": [{"part": k, "ids": list(own)} for k, own in changes]} for s, changes in x] for x in best]
            data = ids.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(np.diff(at)), pa.array([data[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                    pa.array([x[0][0] for x in best], pa.float64()), pa.array(ranked, kind), pa.array(segment.lossless(batch.column("text"), ids, at)),
                ],
                names=[*batch.schema.names, *names],
            )

    return base.mapInArrow(run, f"{ddl}, {RESULT}")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, best_score, the n best scores, and whether the text came back, of `encode_texts`.

    A row each for every row, repeated ones too; the ids of an empty text have crc32 0.
    """
    return encoded.select(
        "doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "best_score",
        F.transform("n_best", lambda b: b["score"]).alias("scores"), "lossless",
    )


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<i4").tobytes())
