"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

An id is replaced by its rank in the order of falling frequency.  A block stores the
ranks of whole documents: first the control bytes, two bits a rank for its length of
1 to 4 bytes, then the data bytes.  Control and data being separate, a block is
decoded without branches: a 256-entry table gives the four lengths of a control
byte, their running sum the place of every rank.

A token file is a folder of tables, written through Spark's committer so that it
survives lost executors: `blocks`, one row a block (part, block, start in its part,
doc_ids, lengths, payload), of about BLOCK_IDS ids in ascending doc_id order; `ranks`,
the id of each rank; `parts`, the number of ids before each part; and `about`, the
tokenizer file's name, the end id and totals.  It is read from these alone.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import forget, keep, new_path
from .textkit import SPACED, Words, chunks, raw

BLOCK_IDS = 1 << 17
MEMO = 150_000  # words whose ids a task remembers, in each of two generations
MAGIC = b"LGVB"
BLOCKS = "part int, block long, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"

MARKS = string.punctuation.encode()
_SHIFT = np.arange(0, 8, 2)
#: lengths of the four ranks under each control byte
LENGTHS = (((np.arange(256)[:, None] >> _SHIFT) & 3) + 1).astype(np.uint8)


def encode_block(ranks: np.ndarray) -> bytes:
    """Header (magic, number of ranks), control bytes, data bytes."""
    ranks = np.asarray(ranks, np.uint32)
    n, most = len(ranks), int(ranks.max(initial=0))
    more = [ranks > np.uint32(limit) for limit in (0xFF, 0xFFFF, 0xFFFFFF) if most > limit]  # has a second, third, fourth byte
    size = np.zeros(-(-n // 4) * 4, np.uint8)
    for m in more:
        size[:n] += m
    four = size.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    at = np.cumsum(size[:n] + np.uint8(1), dtype=np.int64) - 1 - size[:n]
    data = np.zeros(n + sum(int(m.sum()) for m in more), np.uint8)
    data[at] = ranks & np.uint32(0xFF)
    for k, m in enumerate(more, 1):
        data[at[m] + k] = (ranks[m] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return MAGIC + struct.pack("<I", n) + control.tobytes() + data.tobytes()


def decode_block(payload) -> np.ndarray:
    """The ranks of a block."""
    data = np.frombuffer(payload, np.uint8)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a token block")
    n = int(data[4:8].view("<u4")[0])
    controls = -(-n // 4)
    size = LENGTHS[data[8 : 8 + controls]].ravel()[:n]
    at = 8 + controls + np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """Ids of whole texts by a tokenizers file whose pre-tokens never span ASCII white space.

    A text's ids are its words' ids in turn, so each distinct word of a slice is encoded
    once.  Words of ASCII and Latin-1 letters, digits and marks alone need no Unicode
    normalisation but lower-casing; their pre-tokens go to the library's BPE model at
    once, other words through its whole `encode`.  Words are told apart by their
    ASCII-lower-cased bytes unless the slice may hold special tokens, which the library
    matches as written.
    """

    #: fixed values: the pre-token pattern, for the characters that plain words are made of
    PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    PRE_TOKENS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.levels = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x["type"] for x in told["normalizer"]["normalizers"]] if told.get("normalizer") else []
        splits = json.dumps(told.get("pre_tokenizer"), ensure_ascii=False)
        known = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and f'"{known}"' in splits
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelt = piece if piece.isascii() else piece.translate(self.levels)
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(self.pieces) >= 2 * MEMO:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of one word, as little-endian uint32."""
        if self.fast and self.PLAIN.fullmatch(word) and "<|" not in word:
            word = word.lower()
            if word.isalpha():
                return self._piece(word)
            known = self.pieces.get
            return b"".join([known(p) or self._piece(p) for p in self.PRE_TOKENS.findall(word)])
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts."""
        words = Words(column, SPACED)
        text = words.data.tobytes()
        plain = self.fast
        if b"<|" in text:
            words, plain = Words(column, SPACED, lower=False), False
            text = words.data.tobytes()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(words.first), np.int64)
        found, first, index = np.unique(words.hash, return_index=True, return_inverse=True)
        hashes = found.tolist()
        young, old, pieces = self.young, self.old, self.pieces
        known = list(map(young.get, hashes))
        new = [k for k, ids in enumerate(known) if ids is None]
        first = first[new]
        for k, a, b in zip(new, words.start[first].tolist(), words.end[first].tolist(), strict=True):
            h = hashes[k]
            ids = old.get(h)
            if ids is None:
                word = text[a:b]
                core = word.rstrip(MARKS) if plain else b""
                if core.isalpha():  # ASCII letters, lower-cased, and a run of marks: a pre-token each
                    mark, core = word[len(core) :].decode(), core.decode()
                    ids = pieces.get(core) or self._piece(core)
                    if mark:
                        ids += pieces.get(mark) or self._piece(mark)
                else:
                    ids = self.word(word.decode())
            known[k] = young[h] = ids
        if len(young) > MEMO:
            self.old, self.young = young, {}
        size = np.array([len(x) >> 2 for x in known])
        flat = np.frombuffer(b"".join(known), np.uint32)
        base = np.cumsum(size) - size
        n = size[index]
        offsets = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(base[index] - offsets[:-1], n) + np.arange(offsets[-1])]
        return ids, offsets[words.first]


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        kind = np.uint16 if encode.library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        for batch in chunks(batches, most=4_000_000):
            ids, at = encode(batch.column("text"))
            data = np.insert(ids.astype(kind), at[1:], end).tobytes()
            edges = ((at + np.arange(len(at))) * kind().itemsize).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array([kind().itemsize] * batch.num_rows, pa.int32())],
                names=["doc_id", "ids", "width"],
            )

    return run


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x, width in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True):
        yield np.frombuffer(x.as_buffer(), np.uint16 if width == 2 else np.uint32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            data, _ = raw(batch.column("ids"))
            n = np.bincount(np.frombuffer(data.tobytes(), np.uint16 if batch.column("width")[0].as_py() == 2 else np.uint32))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["id", "n"])


def _blocks(ranks_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rank = ranks_of.value
        start = block = held = 0
        docs: list = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([held], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_block(rank[np.concatenate(ids)])], pa.binary()),
                ],
                names=["part", "block", "start", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for doc, mine in zip(batch.column("doc_id").to_pylist(), _ids(batch), strict=True):
                if held and held + len(mine) > BLOCK_IDS:
                    yield row()
                    start, block, held, docs, lengths, ids = start + held, block + 1, 0, [], [], []
                docs.append(doc)
                lengths.append(len(mine))
                ids.append(mine)
                held += len(mine)
        if held:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, end: int, to: str | None = None) -> str:
    """Encode every text and write the token file; returns its folder, `to` or a new one in the shared folder.

    docs: doc_id (integer), text; other columns are ignored.  A null text is empty and has
    the end id alone; a null doc_id sorts first; repeated doc_ids keep a row each, in the order
    of their ids.  An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    to = to or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = keep(rows.mapInArrow(_tokenised(path, end), "doc_id long, ids binary, width int"), "ids")
    counted = ids.select("ids", "width").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r["id"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["id"]))], np.uint32)  # one row an id of the vocabulary
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = keep(
        ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(_blocks(spark.sparkContext.broadcast(rank_of)), BLOCKS), "blocks", f"{to}/blocks"
    )
    forget(ids)
    before, starts = 0, []
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):  # one row a part
        starts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(starts, "part int, before long").coalesce(1).write.parquet(f"{to}/parts")
    ranks = pa.table({"rank": pa.array(np.arange(len(by_rank))), "id": pa.array(by_rank.astype(np.int64))})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{to}/ranks")
    spark.createDataFrame([(os.path.basename(path), end, before)], "tokenizer string, end_id long, n_ids long").coalesce(1).write.parquet(f"{to}/about")
    return to


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token file at `path`: doc_id, start, n_tokens, ids_crc32, all from the decoded blocks.

    start counts the ids of all documents before.  A doc_id that repeats, or is null, has
    a row for each time it was written; a file without blocks gives no rows.
    """
    blocks, parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts")
    ranks = spark.read.parquet(f"{path}/ranks").toArrow()
    by_rank = np.zeros(ranks.num_rows, np.uint32)
    by_rank[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    ids_by_rank = spark.sparkContext.broadcast(by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids_by_rank.value.astype("<u4")
        for batch in batches:
            for k in range(batch.num_rows):
                ids = table[decode_block(batch.column("payload")[k].as_buffer())]
                lengths = batch.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("part")[k].as_py()] * len(lengths), pa.int32()), batch.column("doc_ids")[k].values,
                        pa.array(ends - lengths + batch.column("start")[k].as_py()), pa.array(lengths),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends, strict=True)], pa.int64()),
                    ],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = blocks.select("part", "start", "doc_ids", "lengths", "payload").mapInArrow(
        run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
