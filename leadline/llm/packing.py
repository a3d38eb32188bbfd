"""Best-fit decreasing packing of token sequences into as few sequences of bounded length as it can.

Best-fit decreasing looks at lengths alone: the longest piece goes first, each into the open bin with the
least room that holds it. Pieces of one length follow each other, so a bin that takes one takes as many as
it holds before the next bin of the same room has its turn, and bins of equal room can be moved together.
So the driver packs the histogram of lengths (at most ``limit`` rows, whatever the number of documents):
a segment tree over remaining capacities gives the tightest open room in logarithmic time, and a step
places a whole run of bins. The plan is what packing piece by piece would give. Pieces then find their
bins on the executors, by their number among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.common import id_type, session, text_rows, written
from leadline.llm.short_units import shared_texts

LIMIT = 1024


class OpenBins:
    """Runs of open bins by remaining capacity, under a segment tree of their numbers."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, more: int) -> None:
        i = self.leaves + room
        while i:
            self.tree[i] += more
            i >>= 1

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].pop()

    def tightest(self, need: int) -> int | None:
        """The least room of an open bin that is at least ``need``."""
        i = self.leaves + need
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i == 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], limit: int) -> np.ndarray:
    """Rows (length, number of the first piece, pieces, first bin, pieces a bin, room used before) that place all pieces.

    A length takes at most two runs apart and makes at most two new ones, so there are never more than
    4 * limit runs, and at most 4 * limit rows for each length.
    """
    rows, bins, made = [], OpenBins(limit), 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        done, left = 0, counts[length]

        def place(first: int, n: int, room: int, each: int) -> None:
            nonlocal done, left
            rows.append((length, done, n * each, first, each, limit - room))
            bins.add(room - each * length, first, n)
            done, left = done + n * each, left - n * each

        while left:
            room = bins.tightest(length)
            if room is None:
                first, room = made, limit
                n = -(-left // (limit // length))
                made += n
            else:
                first, n = bins.take(room)
            each = room // length
            if full := min(n, left // each):
                place(first, full, room, each)
                first, n = first + full, n - full
            if n and left:
                place(first, 1, room, left)
                first, n = first + 1, n - 1
            bins.add(room, first, n)
    return np.array(rows, np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The ids of every text, an end after them, in pieces of at most ``limit``; only the first of a text may be shorter.

    Returns doc_id, piece int, start, length, ids_crc32 long, ids array<long> (null unless asked for), and what places
    a piece: task int and nth long, its number among those of its length in the task that made it.
    """
    session(docs)
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = shared_texts(tokenizer), TaskContext.get().partitionId(), [0] * (limit + 1)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for k, got in enumerate(own.texts(batch.column("text"))):
                data = memoryview(got + end)
                a, n, p = 0, len(data) // 4, 0
                while a < n:
                    b = a + ((n - a - 1) % limit + 1)
                    at.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    nth.append(seen[b - a])
                    seen[b - a] += 1
                    ids.append(np.frombuffer(data[4 * a : 4 * b], "<u4") if with_ids else None)
                    a, p = b, p + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], pa.array(ids, pa.list_(pa.int64())), pa.array([task] * len(at), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, piece int, start long, length long, ids_crc32 long, ids array<long>, task int, nth long")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Every text's token ids and an end, packed into as few sequences of at most ``limit`` tokens as best-fit decreasing makes.

    Returns one row for each piece of a text: doc_id, piece int (from 0), start long (ids of the text before it),
    length long, ids_crc32 long (of the ids as little-endian unsigned 32-bit numbers), ids array<long> (null without
    ``with_ids``), sequence_id long (from 0), offset long. Special strings in texts count as the tokenizer's file says.
    A null or empty text is its end alone; without ``end_id`` it has no piece. Texts longer than the limit are cut,
    whatever their length, the first piece holding the rest. Null ids stay null, repeated rows are pieces of their
    own, of pieces of one length any may go first; an empty table gives an empty one; other columns, whatever they
    are called, are not read.
    """
    pieces = written(token_pieces(docs, tokenizer, limit, end_id, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # one row for each length: at most ``limit``
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = plan(histogram, limit)
    key = rows[:, 0] << 44 | rows[:, 1]
    order = np.argsort(key)
    sent = pieces.sparkSession.sparkContext.broadcast((key[order], rows[order]))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    numbered = pieces.join(firsts, ["task", "length"]).select(*columns, (F.col("first") + F.col("nth")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = sent.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = rows[np.searchsorted(key, length << 44 | number, "right") - 1]
            k = number - row[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)], [*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"doc_id {id_type(pieces)}, piece int, start long, length long, ids_crc32 long, ids array<long>, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids array<long> and doc_ids, starts (one for each piece in it) of what ``pack`` gave with ids; a sequence's rows are at most ``limit``."""
    kept = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p")
    return packed.groupBy("sequence_id").agg(kept).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
