"""Hard-negative mining by a Voronoi-partitioned nearest-neighbour join.

Vectors get one more component that makes all norms equal, so that the highest inner
product is the least distance, and go to the cell of their nearest pivot.  Anchors form
groups of neighbouring cells.  A first exact join of each group with its own cells
gives every anchor a score that its answers reach; with it the cell's pivot and the
triangle inequality tell at what distances from the pivot a vector may still serve an
anchor, and only vectors inside of the bounds of some anchor of a group are sent to
that group, where the second exact join finds the answers.  Positives are searched
so, then negatives, whose scores lie in a window under each positive's.

Pivots and bounds save work only: every row is in a cell, and no row that might be an
answer is left out.  Cells and groups are split by ids into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bounded, forget, keep

#: rows that pivots are fitted on, in the mean; most pivots
PIVOT_SAMPLE, PIVOTS = 8192, 512
#: rows of a part of cells, anchors of a group, anchors compared at once
PART, GROUP, TILE = 4096, 2048, 256
#: components beyond it saturate
MOST = float(2**31 - 1)
LOWEST = -(2**63)

_BINS = "group int, bin int"


def _packed(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, anchor, vec (floor(scale * x) of each component, 32 bits each), norm2; rows that take no part are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding").cast(pa.large_list(pa.float64()))
            n = len(lists)
            at = np.asarray(lists.offsets)
            x = lists.values.to_numpy(zero_copy_only=False)  # a null is a NaN here
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            fine = np.asarray(lists.is_valid()) & np.asarray(batch.column("label").is_valid()) & np.asarray(batch.column("vec_id").is_valid()) & (bad[at[1:]] == bad[at[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.clip(np.floor(np.nan_to_num(x * scale, nan=0.0, posinf=MOST, neginf=-MOST)), -MOST, MOST)
            square = np.concatenate([[0.0], np.cumsum(q * q)])
            del x
            vec = q.astype("<i4")
            kept = np.flatnonzero(fine)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(kept)), batch.column("label").take(pa.array(kept)), batch.column("anchor").take(pa.array(kept)),
                    pa.array([vec[at[k] : at[k + 1]].tobytes() for k in kept.tolist()], pa.binary()), pa.array((square[at[1:]] - square[at[:-1]])[kept] if n else np.zeros(0)),
                ],
                names=["vec_id", "label", "anchor", "vec", "norm2"],
            )

    return rows.mapInArrow(pack, "vec_id long, label long, anchor boolean, vec binary, norm2 double")


def _matrix(vecs: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of packed components; a shorter vector's missing components are 0."""
    rows = vecs.to_pylist()
    width = max([width, *(len(r) // 4 for r in rows)])
    return np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in rows), "<i4").reshape(len(rows), width) if width else np.zeros((len(rows), 0), np.int32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with those of b, as 64-bit integers; beyond these they saturate."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    norm = [float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))) for x in (a, b)]
    most = norm[0] * norm[1]  # no partial sum is beyond it
    if most < 2**53 * 0.999:
        kind = np.float32 if most < 2**24 * 0.999 and max(norm) < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Cells:
    """Pivots in the space of equal norms, and what is known of their cells."""

    def __init__(self, sample: np.ndarray, top2: float, n_pivots: int):
        self.top2 = top2  # the largest squared norm
        x = self.augmented(sample.astype(np.float64))
        rng = np.random.default_rng(0)
        self.pivots = np.unique(x[rng.permutation(len(x))[:n_pivots]], axis=0)
        for _ in range(4):  # k-means, a few rounds
            near = self.distances(x).argmin(1)
            count = np.bincount(near, minlength=len(self.pivots))
            total = np.zeros_like(self.pivots)
            np.add.at(total, near, x)
            self.pivots[count > 0] = total[count > 0] / count[count > 0, None]
        self.pivots = self.pivots[self._chain()]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.top2 - (x * x).sum(1)))[:, None]], 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of augmented rows to all pivots."""
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T))

    def _chain(self) -> list[int]:
        """Pivots in an order in which neighbours follow one another."""
        between = self.distances(self.pivots)
        left, order = set(range(1, len(between))), [0]
        while left:
            rest = np.fromiter(left, np.int64)
            order.append(int(rest[between[order[-1], rest].argmin()]))
            left.remove(order[-1])
        return order

    def rows(self, vecs: pa.Array) -> np.ndarray:
        return _matrix(vecs, self.pivots.shape[1] - 1).astype(np.float64)

    def measure(self, found: list) -> None:
        """found: a row each of cell, n, anchors, near, far."""
        n = len(self.pivots)
        self.near, self.far, counts, anchors = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in found:
            counts[r["cell"]], anchors[r["cell"]], self.near[r["cell"]], self.far[r["cell"]] = r["n"], r["anchors"], r["near"], r["far"]
        self.bin, self.bin_parts = _packs(counts, PART)
        self.group, self.group_parts = _packs(anchors, GROUP)

    def bounds(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance from each pivot at which a vector may have a product of `least` and more with each anchor."""
        norm = np.sqrt((x * x).sum(1))
        slack = 1e-5 * (1 + np.sqrt(self.top2) + norm)[:, None]
        away = self.distances(np.concatenate([x, np.zeros((len(x), 1))], 1))
        reach = np.sqrt(np.maximum(0, self.top2 + norm * norm - 2 * least))[:, None]
        inner = x @ self.pivots[:, :-1].T
        # x.y = x.p + x.(y - p), at most x.p + |x| d
        with np.errstate(divide="ignore", invalid="ignore"):
            by_pivot = np.where(norm[:, None] > 0, (least[:, None] - inner) / norm[:, None], np.where(least[:, None] > 0, np.inf, -np.inf))
        return np.maximum(away - reach, by_pivot) - slack, away + reach + slack


def _packs(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first pack of each cell and in how many packs it is dealt; small neighbours share one."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, room = -1, 0
    for c, n in enumerate(counts.tolist()):
        if n > most:
            parts[c] = -(-n // most)
            first[c] = at + 1
            at, room = at + int(parts[c]), 0
        else:
            if n > room or at < 0:
                at, room = at + 1, most
            first[c] = at
            room -= n
    return first, parts


def _best(anchor: np.ndarray, score: np.ndarray, col: np.ndarray, most: int) -> np.ndarray:
    """Places of each anchor's first entries by score, then by column."""
    order = np.lexsort((col, -score, anchor))
    a = anchor[order]
    start = np.concatenate([[True], a[1:] != a[:-1]])
    first = np.flatnonzero(start)
    return order[np.arange(len(a)) - first[np.cumsum(start) - 1] < most]


def _once(t: pa.Table) -> pa.Table:
    """Rows by id, of repeated ones the first."""
    order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    ids = t.column("vec_id").to_numpy()
    if len(np.unique(ids)) == len(ids):
        return t
    seen, kept = set(), []
    for k, row in enumerate(zip(ids.tolist(), t.column("label").to_pylist(), t.column("vec").to_pylist(), strict=True)):
        if row not in seen:
            seen.add(row)
            kept.append(k)
    return t.take(pa.array(kept))


def _tiles(rows: pa.Table, anchors: pa.Table):
    """(first anchor of a tile, products, whether labels agree), rows and anchors by id; an anchor's own id is far below all."""
    ids, labels, x = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("vec"))
    own, own_labels, a = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vec"))
    for at in range(0, len(own), TILE):
        some = slice(at, at + TILE)
        yield at, products(a[some], x), own_labels[some, None] == labels, own[some, None] == ids


def _positives_of(most: int):
    schema = "anchor_id long, anchor_key long, vec_id long, score long"

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = _once(rows), _once(anchors)
        ids, own, key = (t.column(c).to_numpy() for t, c in ((rows, "vec_id"), (anchors, "vec_id"), (anchors, "anchor_key")))
        least, out = anchors.column("least").to_numpy(), []
        for at, s, same, itself in _tiles(rows, anchors):
            r, c = np.nonzero(same & ~itself & (s >= least[at : at + TILE, None]))
            kept = _best(r, s[r, c], c, most)
            r, c = r[kept], c[kept]
            out.append(pa.table([own[at + r], key[at + r], ids[c], s[r, c]], names=["anchor_id", "anchor_key", "vec_id", "score"]))
        return pa.concat_tables(out) if out else _none(schema)

    return find, schema


def _negatives_of(most: int, high: int):
    schema = "anchor_id long, anchor_key long, place int, vec_id long, score long"

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = _once(rows), _once(anchors)
        ids, own, key = (t.column(c).to_numpy() for t, c in ((rows, "vec_id"), (anchors, "vec_id"), (anchors, "anchor_key")))
        tops, floors = anchors.column("tops").to_pylist(), anchors.column("floors").to_pylist()
        width = max([1, *map(len, tops)])
        ceiling, floor = np.full((len(own), width), -1, np.int64), np.full((len(own), width), 2**63 - 1, np.int64)  # an open place takes nothing
        for k, (t, f) in enumerate(zip(tops, floors, strict=True)):
            ceiling[k, : len(t)] = [x * high // 100 for x in t]
            floor[k, : len(f)] = f
        out = []
        for at, s, same, itself in _tiles(rows, anchors):
            low, up = floor[at : at + TILE], ceiling[at : at + TILE]
            r, c = np.nonzero(~same & ~itself & (s >= low.min(1)[:, None]) & (s <= up.max(1)[:, None]))
            v = s[r, c]
            for j in range(width):
                inside = np.flatnonzero((v >= low[r, j]) & (v <= up[r, j]))
                kept = inside[_best(r[inside], v[inside], c[inside], most)]
                out.append(pa.table([own[at + r[kept]], key[at + r[kept]], np.full(len(kept), j + 1, np.int32), ids[c[kept]], v[kept]], names=["anchor_id", "anchor_key", "place", "vec_id", "score"]))
        return pa.concat_tables(out) if out else _none(schema)

    return find, schema


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]).empty_table()


def _joined(vectors: DataFrame, anchors: DataFrame, needs: DataFrame, find, schema: str) -> DataFrame:
    """find over all vectors that a group needs, a part of cells at a time.

    needs: group, cell, part, bin, low, high: the distances from the cell's pivot between which vectors go to the group.
    """
    sent = vectors.join(needs, ["cell", "part"]).where("away >= low AND away <= high").select("group", "bin", "vec_id", "label", "vec")
    asked = anchors.join(needs.select("group", "bin").distinct(), "group")
    sent, asked = (x.toDF(*x.columns) for x in (sent, asked))  # both come of one table; columns of their own tell them apart
    return sent.groupBy("group", "bin").cogroup(asked.groupBy("group", "bin")).applyInArrow(find, schema)


def _needs(anchors: DataFrame, cells, least: str) -> DataFrame:
    """group, cell, part, bin, low, high of the vectors that may score `least` and more with some anchor of a group."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                some, c = batch.slice(at, TILE), cells.value
                least = some.column("least").to_numpy().astype(np.float64)
                low, high = c.bounds(c.rows(some.column("vec")), np.where(least <= LOWEST, -np.inf, least))
                serves = (low <= c.far) & (high >= c.near)
                group = some.column("group").to_numpy()
                for g in np.unique(group):
                    own = group == g
                    cell = np.flatnonzero(serves[own].any(0))
                    low_, high_ = (np.where(serves[own], x[own], worst)[:, cell] for x, worst in ((low, np.inf), (high, -np.inf)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g, np.int32)), pa.array(cell.astype(np.int32)), pa.array(low_.min(0)), pa.array(high_.max(0))], names=["group", "cell", "low", "high"])

    found = anchors.select("group", "vec", F.expr(least).alias("least")).mapInArrow(bound, "group int, cell int, low double, high double")
    wide = found.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return wide.join(F.broadcast(_layout(anchors.sparkSession, cells.value)), "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).selectExpr(
        "group", "cell", "cast(part as int) AS part", "cast(first + part as int) AS bin", "low", "high")


def _layout(spark, c: Cells) -> DataFrame:
    """cell, first, parts: where the parts of each cell are; PIVOTS rows at most."""
    return spark.createDataFrame([(k, int(c.bin[k]), int(c.bin_parts[k])) for k in range(len(c.pivots))], "cell int, first int, parts int")


def _home(anchors: DataFrame, cells) -> DataFrame:
    """As `_needs`, of the first part of each anchor's own cell only."""
    own = anchors.select("group", "cell").distinct().join(F.broadcast(_layout(anchors.sparkSession, cells.value)), "cell")
    return own.selectExpr("group", "cell", "0 AS part", "first AS bin", "cast(0 as double) AS low", "cast('Infinity' as double) AS high")


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: any columns with vec_id, embedding and label; `anchor` is an SQL condition on
    them.  Vectors become integers, floor(scale * x); a score is an integer inner product;
    higher scores come first, on ties the smaller vec_id.  Positives of an anchor are its
    first rows of the same label, negatives of a positive the first rows of other labels
    whose score is between low and high hundredths of the positive's.

    Rows with a null id, label, vector or component, or one that isn't finite, take no
    part.  A shorter vector's missing components are 0; components beyond 32 bits
    saturate.  Rows repeated whole count once; rows that share an id but differ are rows
    of their own, but no answers to one another.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    bounded(spark)
    packed = _packed(rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label"), F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor")), scale)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, top2, width = packed.agg(F.count("*"), F.max("norm2"), F.max(F.length("vec"))).first()
    if not n:
        return spark.createDataFrame([], result)
    share = min(1.0, PIVOT_SAMPLE / n)
    sample = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * PIVOT_SAMPLE).select("vec").toArrow()
    if not len(sample):
        sample = packed.limit(1).select("vec").toArrow()
    cells = Cells(_matrix(sample.column("vec"), width // 4), top2, max(1, min(PIVOTS, round(n**0.5 / 2))))
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                some = batch.slice(at, PART)
                d = c.distances(c.augmented(c.rows(some.column("vec"))))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "label", "anchor", "vec", "cell", "away"])

    placed = keep(packed.mapInArrow(assign, "vec_id long, label long, anchor boolean, vec binary, cell int, away double"), "cells")
    cells.measure(placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.min("away").alias("near"), F.max("away").alias("far")).collect())
    shared.unpersist()
    shared = spark.sparkContext.broadcast(cells)
    deal = spark.createDataFrame([(k, int(cells.bin_parts[k]), int(cells.group[k]), int(cells.group_parts[k])) for k in range(len(cells.pivots))], "cell int, parts int, g int, gs int")
    dealt = placed.join(F.broadcast(deal), "cell").withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)"))
    vectors = dealt.select("vec_id", "label", "vec", "cell", "part", "away")
    anchors = dealt.where("anchor").select("vec_id", "label", "vec", "cell", F.xxhash64("label", "vec").alias("anchor_key"), F.expr("cast(g + pmod(xxhash64(vec_id, 7), gs) as int)").alias("group")).distinct()

    own = ["anchor_id", "anchor_key"]
    named = anchors.withColumnsRenamed({"vec_id": "anchor_id"})
    back = lambda df: df.withColumnsRenamed({"anchor_id": "vec_id"})

    # positives: a score that enough rows reach, then all rows that may reach it
    find, schema = _positives_of(positives)
    home = _joined(vectors, anchors.withColumn("least", F.lit(LOWEST)), _home(anchors, shared), find, schema)
    reached = _first(home, own, positives).groupBy(*own).agg(F.when(F.count("*") == positives, F.min("score")).alias("least"))
    asked = keep(back(named.join(reached, own, "left").withColumn("least", F.coalesce("least", F.lit(LOWEST)))), "asked")
    found = _first(_joined(vectors, asked, _needs(asked, shared, "least"), find, schema), own, positives)
    pairs = found.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))  # `positives` at most
    tops = keep(back(named.join(pairs, own).withColumn("tops", F.expr("transform(positives, p -> p.score)"))), "positives")

    # negatives, the same way; below 0 no score is in the window, as low < high
    window = f"transform(tops, s -> IF(s < 0, {2**63 - 1}L, cast(ceil(s * cast({low} as decimal(10, 0)) / 100) as long)))"
    find, schema = _negatives_of(negatives, high)
    first = tops.withColumn("floors", F.expr(window))
    home = _joined(vectors, first, _home(first, shared), find, schema)
    reached = _first(home, [*own, "place"], negatives).groupBy(*own, "place").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == negatives)
    raised = reached.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("raised"))
    floors = "transform(floors, (f, j) -> greatest(f, coalesce(raised[j + 1], f)))"
    asked2 = keep(back(first.withColumnsRenamed({"vec_id": "anchor_id"}).join(raised, own, "left").withColumn("floors", F.expr(floors))), "floors")
    best = _first(_joined(vectors, asked2, _needs(asked2, shared, "array_min(floors)"), find, schema), [*own, "place"], negatives)
    out = best.join(asked2.select(F.col("vec_id").alias("anchor_id"), "anchor_key", "positives"), own).selectExpr(
        "anchor_id", "positives[place - 1].vec_id AS positive_id", "cast(rank as int) AS rank", "vec_id AS negative_id", "positives[place - 1].score AS positive_score", "score AS negative_score")
    kept = keep(out, "negatives")
    forget(placed, asked, tops, asked2)
    return kept
