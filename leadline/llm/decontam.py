"""Benchmark passages in whole texts: q-gram lemma filtering in diagonal bands, then banded alignment.

A passage of m characters that occurs with at most k edits keeps at least m - q + 1 - k * q of its
q-grams, all on diagonals (place in the text less place in the passage) that span at most k. So every
occurrence lies within one of the overlapping bands of 2 * (k + 1) diagonals that start at multiples of
k + 1. Each text's q-grams are hashed by whole arrays and looked up in a bit table of the benchmark's;
hits are counted by passage and band, distinct places in the passage only (of a q-gram that is frequent in both, from
running sums), and a band that reaches the bound is verified by alignment within the band, with free ends in the text. A passage shorter than q has
no q-gram and no budget: its occurrences are looked up by a hash of all its characters.

Passages are broadcast in blocks of at most ``block_chars`` characters (a passage longer than that is a
block alone); a benchmark beyond one block costs further passes over the texts, each of which is written
before the next block is sent, so no more than one block is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import id_type, session, text_rows, written

Q, RATE = 8, 0.1
BLOCK_CHARS = 1 << 21
#: Characters of a text handled at a time.
WINDOW = 1 << 16

#: Pairs of places beyond which a q-gram's aren't made one by one, and bands of a passage beyond which those that touch are aligned as one.
OFTEN, MANY_BANDS = 1 << 15, 8
#: Characters of the q-grams that decide where longer ones leave many bands.
FINE_Q = 4

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Each code point's lower case where that is one character; white space is a space."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isspace():
            out[c] = 32
        elif len(low := s.lower()) == 1:
            out[c] = ord(low)
    return out


def folded(text: str) -> np.ndarray:
    """Code points without case, as long as the text."""
    return _lower()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on, by doubling."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    v = c.astype(np.uint64)
    h, have = v, 1
    for bit in bin(q)[3:]:
        h = h[: len(h) - have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
        have *= 2
        if bit == "1":
            h = h[: len(v) - have] * np.uint64(_BASE) + v[have:]
            have += 1
    return h * np.uint64(0xFF51AFD7ED558CCD)


class Passages:
    """An index of a block of passages."""

    def __init__(self, ids: list, texts: list[str], q: int, rate: float, edits: np.ndarray | None = None):
        self.q, self.given, self._finer = q, (ids, texts, rate), None
        kept = [(i, folded(t)) for i, t in zip(ids, texts, strict=True) if t]
        self.ids, self.chars = [i for i, _ in kept], [c for _, c in kept]
        self.size = np.array([len(c) for c in self.chars], np.int64)
        self.edits = np.maximum(0, np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)) if edits is None else edits
        self.least = self.size - q + 1 - self.edits * q
        h = [gram_hashes(c, q) for c in self.chars]
        hashes = np.concatenate(h) if h else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.keys, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.shift = np.uint64(64 - min(25, max(16, int(len(self.keys)).bit_length() + 4)))
        self.there = np.zeros(1 << 64 - int(self.shift), bool)
        self.there[self.keys >> self.shift] = True
        self.reach = int((self.size + self.edits).max()) + q if len(self.size) else 0
        # passages without a q-gram: by length, their hashes in order and whose they are
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, q):
            own = np.flatnonzero(self.size == m)
            if len(own):
                hashes = np.array([gram_hashes(self.chars[p], m)[0] for p in own])
                order = np.argsort(hashes, kind="stable")
                self.short[m] = hashes[order], own[order]

    def shared(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the key, place in the text) of each of the text's q-grams that a passage has."""
        h = gram_hashes(c, self.q)
        j = np.flatnonzero(self.there[h >> self.shift]) if len(self.keys) else np.empty(0, np.int64)
        at = np.searchsorted(self.keys, h[j])
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == h[j[ok]]
        return at[ok], j[ok]

    def postings(self, at: np.ndarray) -> np.ndarray:
        """Places in ``item`` and ``place`` of the keys' postings, key by key."""
        n = self.first[at + 1] - self.first[at]
        return np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def candidates(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(passage, first diagonal) of each band with enough different q-grams.

        A q-gram that is frequent both here and in the passages (a run of blanks) isn't paired place by place:
        how many of a passage's places with it have one in a band comes from running sums over the text.
        """
        at, j = self.shared(c)
        if not len(at):
            return []
        keys, back, here = np.unique(at, return_inverse=True, return_counts=True)
        often = here * (self.first[keys + 1] - self.first[keys]) > OFTEN
        light, frequent = ~often[back], keys[often]
        more = np.bincount(self.item[self.postings(frequent)], minlength=len(self.size)) if len(frequent) else np.zeros(len(self.size), np.int64)
        post = self.postings(at[light])
        item, i, j_light = self.item[post].astype(np.int64), self.place[post].astype(np.int64), np.repeat(j[light], self.first[at[light] + 1] - self.first[at[light]])
        enough = np.bincount(item, minlength=len(self.size)) + more >= self.least  # no band has more than all
        item, i, j_light = (x[enough[item]] for x in (item, i, j_light))
        item, band, count = self._counted(item, i, j_light)
        few = count >= self.least[item]
        if not len(frequent):
            return [(int(p), int(b * (self.edits[p] + 1))) for p, b in zip(item[few], band[few], strict=True)]
        own = few & (more[item] == 0)
        out = [(int(p), int(b * (self.edits[p] + 1))) for p, b in zip(item[own], band[own], strict=True)]
        where = {int(k): np.sort(j[at == k]) for k in frequent}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for p in np.flatnonzero((more > 0) & enough).tolist():
            width = int(self.edits[p]) + 1
            low = -(int(self.size[p]) // width) - 2
            bands = np.arange(low, len(c) // width + 1)
            total = np.zeros(len(bands), np.int64)
            mine = item == p
            total[band[mine] - low] = count[mine]
            for k in where:
                places = np.sort(self.place[self.first[k] : self.first[k + 1]][self.item[self.first[k] : self.first[k + 1]] == p]).astype(np.int64)
                if not len(places):
                    continue
                if (k, width) not in sums:
                    sums[k, width] = _reached(where[k], len(c), 2 * width)
                running = sums[k, width]
                ends = np.flatnonzero(np.diff(places) > 1)
                first, last = places[np.concatenate([[0], ends + 1])], places[np.concatenate([ends, [len(places) - 1]])] + 1
                before = lambda x: running[np.clip(x + 2 * width - 1, 0, len(running) - 1)]  # noqa: B023, E731
                for a, b in zip(first, last, strict=True):
                    total += before(b + bands * width) - before(a + bands * width)
            out += [(p, int(b * width)) for b in bands[total >= self.least[p]]]
        if self.q > FINE_Q and max((len(x) for _, x in _by_passage(out)), default=0) > MANY_BANDS:
            # what is frequent alone reaches the bound: shorter q-grams have a higher one
            fine = set(self.finer().candidates(c))
            out = [x for x in out if x in fine]
        return out

    def finer(self) -> Passages:
        """The same passages and budgets with short q-grams: of those an edit destroys fewer."""
        if self._finer is None:
            ids, texts, rate = self.given
            self._finer = Passages(ids, texts, FINE_Q, rate, self.edits)
        return self._finer

    def _counted(self, item: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, band, how many places of the passage) of hits; each is in two bands."""
        if not len(item):
            return item, item, item
        band = (j - i) // (self.edits[item] + 1)
        item, i, band = np.concatenate([item, item]), np.concatenate([i, i]), np.concatenate([band, band - 1])
        order = np.lexsort((i, band, item))
        item, i, band = item[order], i[order], band[order]
        new_band = np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        new = new_band.copy()
        new[1:] |= i[1:] != i[:-1]
        first = np.flatnonzero(new_band)
        return item[first], band[first], np.add.reduceat(new.astype(np.int64), first)

    def short_ones(self, c: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, place in the text) of passages shorter than q that are there, places ascending."""
        for m, (hashes, whose) in self.short.items():
            for at in range(0, len(c) - m + 1, WINDOW):
                h = gram_hashes(c[at : at + WINDOW + m - 1], m)
                for j in np.flatnonzero(np.isin(h, hashes)):
                    for p in whose[np.searchsorted(hashes, h[j]) : np.searchsorted(hashes, h[j], "right")]:
                        if np.array_equal(self.chars[p], c[at + j : at + j + m]):
                            yield int(p), int(at + j)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(passage, edits, start, end) of the best occurrence of each passage that is in the text."""
        c = folded(text)
        best: dict[int, tuple[int, int, int]] = {}
        for at in range(0, max(1, len(c) - self.q + 1), WINDOW):
            part = c[at : at + WINDOW + 2 * self.reach]
            for p, starts in _by_passage(self.candidates(part)):
                k = int(self.edits[p])
                for d, width in _ranges(starts, 2 * k + 2):
                    if p in best and best[p][0] == 0:
                        break
                    if got := occurrence(self.chars[p], part, d, k, width):
                        got = (got[0], got[1] + at, got[2] + at)
                        best[p] = min(best.get(p, got), got)
        for p, j in self.short_ones(c):
            best.setdefault(p, (0, j, j + len(self.chars[p])))
        return [(p, *x) for p, x in sorted(best.items())]


def _reached(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """Running count, from the place 1 - width of a text of n on, of places with one of ``places`` less than width on."""
    there = np.zeros(n + 2 * width, np.int64)
    there[places + width - 1] = 1
    total = np.concatenate([[0], np.cumsum(there)])
    near = total[width : width + n + width - 1] > total[: n + width - 1]
    return np.concatenate([[0], np.cumsum(near)])


def _place_of(p: np.ndarray, c: np.ndarray) -> int | None:
    """Where the characters p first stand in c."""
    whole, part, at = c.tobytes(), p.tobytes(), -1
    while (at := whole.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return None


def _by_passage(found: list[tuple[int, int]]) -> Iterator[tuple[int, list[int]]]:
    starts: dict[int, list[int]] = {}
    for p, d in found:
        starts.setdefault(p, []).append(d)
    yield from sorted(starts.items())


def _ranges(starts: list[int], width: int) -> Iterator[tuple[int, int]]:
    """Bands as they are; where a passage has many, those that touch as one wide one, so that each diagonal is aligned once."""
    starts = sorted(starts)
    if len(starts) <= MANY_BANDS:
        yield from ((d, width) for d in starts)
        return
    first, last = starts[0], starts[0]
    for d in starts[1:]:
        if d > last + width:
            yield first, last + width - first
            first = d
        last = d
    yield first, last + width - first


def occurrence(p: np.ndarray, c: np.ndarray, d: int, k: int, width: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the passage in the text within a band of diagonals from d on, if it has at most k; a band has 2 * (k + 1) if nothing else is said."""
    width = 2 * k + 2 if width is None else width
    if width == 2 * k + 2:
        for t in range(width):
            if d + t >= 0 and d + t + len(p) <= len(c) and np.array_equal(p, c[d + t : d + t + len(p)]):
                return 0, d + t, d + t + len(p)
    elif (at := _place_of(p, c[max(0, d) : d + width + len(p)])) is not None:
        return 0, max(0, d) + at, max(0, d) + at + len(p)
    row = _align(p, c, d, width, None)
    t = int(row.argmin())
    if row[t] > k:
        return None
    end = min(len(c), len(p) + d + t)
    # the same from its end, backwards, for where it starts
    back = _align(p[::-1], c[:end][::-1], -k - 1, 2 * k + 3, k + 1)
    near = np.flatnonzero(back == row[t])
    start = max(0, end - (len(p) - k - 1 + int(near[0]))) if len(near) else max(0, end - len(p))
    return int(row[t]), start, end


def _align(p: np.ndarray, c: np.ndarray, d: int, width: int, start: int | None) -> np.ndarray:
    """Edits of the whole passage by the diagonal it ends on, within a band; it starts on any diagonal or on one."""
    far = len(p) + len(c) + 1
    steps = np.arange(width)
    j = d + steps  # place in the text before each row
    row = np.where((j >= 0) & (j <= len(c)), 0, far)
    if start is not None:
        row[steps != start] = far
        row = np.minimum.accumulate(row - steps) + steps
    padded = np.full(max(0, -d) + len(c) + max(0, len(p) + d + width - len(c)) + 1, 2**32 - 1, np.uint32)
    base = max(0, -d)
    padded[base : base + len(c)] = c
    for i in range(len(p)):
        seen = padded[base + d + i : base + d + i + width] if base + d + i >= 0 else padded[:width]
        j = d + i + 1 + steps
        new = row + (seen != p[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((j >= 0) & (j <= len(c)), new, far)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where((j >= 0) & (j <= len(c)), row, far)
    return row


def _blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """The passages, in blocks of at most so many characters, or of a single passage."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        worst = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("size"), F.count_distinct("text").alias("n")).filter((F.col("size") > block_chars) & (F.col("n") > 1)).limit(1).count()
        if n == 1 or not worst:
            break
        n *= 2
    for b in range(n):
        rows = dealt.filter(F.col("block") == b).select("item_id", "text").collect()
        if rows:
            yield [r.item_id for r in rows], [r.text for r in rows]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))


def clean_texts(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, with all their columns, in whose text no passage occurs (as in ``contaminated``); nothing is shuffled.

    Null and empty texts are kept, and so are rows with null ids; very long texts are read whole; repeated rows
    have one fate, an empty table gives an empty one. Columns of any other name are passed on.
    """
    spark = session(docs)
    out, blocks = docs, _blocks(_items(benchmark, item_col, item_text_col), block_chars)
    earlier = None
    for ids, texts in blocks:
        if earlier is not None:
            out = written(out, "clean")
            earlier.destroy()
        passages = earlier = spark.sparkContext.broadcast(Passages(ids, texts, q, rate))

        def run(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not passages.value.find(v.as_py() or "") for v in batch.column(text_col)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The passages that occur in each whole text with at most rate * length edits.

    Case and the kind of white space don't count. Where a passage is so short that the lemma's bound would
    be under one q-gram, its budget shrinks until the bound is one; passages under q characters have no
    q-gram and count where they occur without an edit. Returns one row for each text and passage found:
    doc_id, item_id, edits int, start_char, end_char long (code points of the best occurrence, the first of
    equal ones). Texts without a passage have no row. Null and empty texts and passages match nothing, very
    long texts are read whole in windows, null ids are kept as they are, repeated rows of either table give
    repeated results, empty tables an empty one; other columns, whatever they are called, are not read.
    """
    spark = session(docs)
    rows = text_rows(docs, id_col, text_col)
    items = _items(benchmark, item_col, item_text_col)
    kinds = (id_type(rows), id_type(items, "item_id"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, start_char long, end_char long"
    out, last, earlier = None, None, None
    for ids, texts in _blocks(items, block_chars):
        if last is not None:
            done = written(last, "found")
            out = done if out is None else out.unionByName(done)
            earlier.destroy()
        earlier = spark.sparkContext.broadcast(Passages(ids, texts, q, rate))
        last = _found(rows, earlier, schema)
    if last is None:
        return spark.createDataFrame([], schema)
    return last if out is None else out.unionByName(last)


def _found(rows: DataFrame, passages, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Passages = passages.value
        for batch in batches:
            at, item, rest = [], [], []
            for k, value in enumerate(batch.column("text")):
                for p, *x in index.find(value.as_py() or ""):
                    at.append(k)
                    item.append(index.ids[p])
                    rest.append(x)
            if at:
                e, s, t = zip(*rest, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(item), pa.array(e, pa.int32()), pa.array(s, pa.int64()), pa.array(t, pa.int64())], ["doc_id", "item_id", "edits", "start_char", "end_char"])

    return rows.mapInArrow(run, schema)
