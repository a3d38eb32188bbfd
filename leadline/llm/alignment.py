"""Byte alignment of two tokenizers' tokens, and how usual each linked pair of ids is in the corpus.

A text is cut in its bytes into units that neither tokenizer's tokens go over (``short_units``, but where an
entry of B would be cut); each unit is encoded and aligned once, new ones of a batch together, and then looked
up. Two tokens are linked where their byte ranges overlap; places where both
end cut the tokens into groups.

Corpus counts come from a cogroup of postings. Each task gathers documents into chunks and, for each of
``SIDES`` ranges of side ids (a hash of the B id), makes one row of the chunk's (pair, document, multiplicity)
postings in order of the pair. Pair counts, summed over all chunks, go before the postings of their range in one
sorted stream; a range with many postings is dealt by chunk to as many tasks as it needs, so that no id, however
usual, is one task's. Each task finds counts and each B id's highest, and gives its documents'
contributions, which are then summed by document. What a task holds beside one chunk's row are the counts of
its range, of which there are at most as many as pairs of entries of both vocabularies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.bpe import TABLE_PIECES, merges
from leadline.llm.common import id_type, session, text_rows, written
from leadline.llm.short_units import COUNT_BITS, MOST, SHORT, STARTS, Shelf, cut_units, cuts, different, unit_ids
from leadline.llm.units import TOGETHER, WINDOW, stretches

#: Ranges of side ids.
SIDES = 64
#: Documents, (document, unit) pairs and characters of kept groups that end a chunk.
CHUNK_DOCS, CHUNK_ENTRIES, KEPT_CHARS = 1 << 14, 1 << 20, 1 << 26
#: Postings of a range that one task takes.
TASK_POSTINGS = 1 << 21
#: An id fits in so many bits.
_BITS = 24


@lru_cache(maxsize=4)
def side_pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The processor and each id's bytes."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def crossed(entries: list[bytes]) -> np.ndarray:
    """The bytes before which an entry would be cut, were it a text: there tokens may go over a cut."""
    out = np.zeros(256, bool)
    for x in entries:
        data = np.frombuffer(x + bytes(SHORT), np.uint8)
        at = cuts(data, len(x))
        out[data[at[(at > 0) & (at < len(x))]]] = True
    return out


@lru_cache(maxsize=2)
def shared_units(a_path: str, b_path: str) -> Aligned:
    """This process's table, which its next task finds as the last one has left it."""
    return Aligned(a_path, b_path)


class Aligned:
    """Units of both tokenizers by number: token, group and link counts, groups as text, pairs of ids as 64-bit numbers."""

    def __init__(self, a_path: str, b_path: str):
        self.a_path, of = a_path, merges(a_path).bytes_of
        self.a_bytes = [of.get(i, b"") for i in range(max(of) + 1)]
        self.sp, self.b_bytes = side_pieces(b_path)
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.never = crossed(self.b_bytes)
        # what goes before a unit so that the processor's own space isn't the unit's, and how many tokens it has
        self.lead = [(x, len(self.sp.encode(x))) for x in ("a\n", "a")]
        self.whole = bool(self.never[32]) or any(b"".join(self.b_bytes[i] for i in self.sp.encode(x)) != b" " + x.encode() for x, _ in self.lead)
        if self.whole:  # a text is one unit
            self.never[:] = True
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = np.array([*map(len, digits)], np.int64)
        most = int(self.width.max()) + 1
        self.digits = np.frombuffer(b"".join([x.ljust(most, b"\0") for x in digits]), np.uint8).reshape(-1, most)
        self.reset()

    def reset(self) -> None:
        self.short: list[Shelf] = []
        self.long: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.pairs: list[bytes] = []
        self.counts = np.zeros((1 << 12, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a is -1 where bytes differ
        self.chars = 0

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts by number, one after another, and where each text's begin and the last one's end.

        New units of all the texts are encoded together: many at once take less time for each.
        """
        raw = [(" " + t).encode() if t else b"" for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        number, start = self._units(b"".join(raw), at)
        return number, np.searchsorted(start, at)

    def numbers(self, text: str) -> Iterator[np.ndarray]:
        """The units of a text that is not empty, by number, in parts."""
        for s in [" " + text] if self.whole else stretches(" " + text):
            raw = s.encode()
            yield self._units(raw, np.array([0, len(raw)]))[0]

    def _units(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the beginning of each unit of texts that begin at the given places."""
        start, size, long, low, high = cut_units(raw, at, self.never)
        number, short = np.empty(len(start), np.int64), np.flatnonzero(~long)
        for shelf in self.short:
            found = shelf.find(low[short], high[short])
            has = found > 0
            number[short[has]] = shelf.ids[found[has] >> COUNT_BITS]
            short = short[~has]
        low, high, of = different(low[short], high[short])
        chars = np.stack([low, high], 1).astype("<u8")
        data, own = chars.tobytes(), (chars.view(np.uint8) != 0).sum(1).tolist()
        new = [data[k : k + n] for k, n in zip(range(0, len(data), SHORT), own, strict=True)]
        others = [raw[a : a + n] for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
        new_long = [u for u in dict.fromkeys(others) if u not in self.long]
        if new or new_long:
            n = len(self.groups)
            self._add(new + new_long)
            number[short] = n + of
            for k in range(0, len(new), MOST):
                some = np.arange(k, min(k + MOST, len(new)))
                if not self.short or self.short[-1].n + len(some) > MOST:
                    self.short.append(Shelf())
                self.short[-1].put(low[some], high[some], np.ones(len(some), np.int64), (n + some).astype(np.uint32))
            self.long.update(zip(new_long, range(n + len(new), len(self.groups)), strict=True))
        number[long] = [*map(self.long.__getitem__, others)]
        return number, start

    def _add(self, new: list[bytes]) -> None:
        """Encodes and aligns units, which take the next numbers."""
        count_a, a = unit_ids(self.a_path, new)
        if self.whole:
            got = self.sp.encode([u[1:].decode() for u in new], num_threads=1)
        else:
            lead = [self.lead[u[0] in STARTS] for u in new]
            got = self.sp.encode([x + u.decode() for (x, _), u in zip(lead, new, strict=True)], num_threads=1)
            got = [y[n:] for (_, n), y in zip(lead, got, strict=True)]
        count_b, b = np.array([*map(len, got)], np.int64), np.array([*chain.from_iterable(got)], np.int64)
        sides = (count_a, a.astype(np.int64), self.a_size, self.a_bytes), (count_b, b, self.b_size, self.b_bytes)
        size = np.array([*map(len, new)], np.int64)
        good = np.ones(len(new), bool)
        for count, ids, sizes, entries in sides:
            good &= summed(sizes[ids], np.cumsum(count)) == size
        for count, ids, sizes, entries in sides:
            if b"".join(map(entries.__getitem__, ids[np.repeat(good, count)].tolist())) != b"".join(compress(new, good.tolist())):
                ends = np.cumsum(count).tolist()
                good &= [b"".join(map(entries.__getitem__, ids[e - n : e].tolist())) == u for u, n, e in zip(new, count.tolist(), ends, strict=True)]
        at = len(self.groups)
        while at + len(new) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        counts = self.counts[at : at + len(new)]
        counts[:] = (-1, 0, 0, 0)
        kept = [x for count, ids, *_ in sides for x in (count[good], ids[np.repeat(good, count)])]
        counts[good], texts, pairs = self._aligned(size[good], *kept)
        if good.all():
            self.groups += texts
            self.pairs += pairs
        else:
            texts, pairs = iter(texts), iter(pairs)
            self.groups += [next(texts) if x else b"" for x in good.tolist()]
            self.pairs += [next(pairs) if x else b"" for x in good.tolist()]
        self.chars += sum(map(len, self.groups[at:]))

    def _aligned(self, size: np.ndarray, count_a: np.ndarray, a: np.ndarray, count_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Counts, groups (each with a mark behind it) and pairs of units of so many bytes and tokens."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # a stretch between ends is of one token of each side
        ends = np.sort(np.concatenate([ends_a, ends_b]))
        ends = ends[np.append(ends[1:] != ends[:-1], True)[: len(ends)]]
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = ends[ends_a[i] == ends_b[j]]
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        # a group's tokens of A, then of B
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a] = np.where(both[group_a] == ends_a, ord("|"), ord(","))
        mark[at_b] = np.where(both[group_b] == ends_b, ord(";"), ord(","))
        chars, width = self.digits[ids], self.width[ids]
        chars[np.arange(len(ids)), width] = mark
        stop = np.cumsum(size)
        groups, links = np.searchsorted(both, stop, "right"), np.searchsorted(ends, stop, "right")
        texts = split(chars[chars != 0].tobytes(), np.append(0, np.cumsum(width + 1))[np.cumsum(count_a + count_b)])
        pairs = split((b[j] << _BITS | a[i]).astype("<i8").tobytes(), 8 * links)
        return np.stack([count_a, count_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)], 1), texts, pairs


def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches of values, which may be empty, up to each end."""
    return np.diff(np.concatenate([np.zeros_like(values[:1], shape=(1, *values.shape[1:])), np.cumsum(values, 0)])[ends], axis=0, prepend=0)


def split(data: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def sides_of(codes: np.ndarray) -> np.ndarray:
    """The range of each pair, by its B id."""
    return ((codes >> _BITS) * 2654435761 >> 12) % SIDES


class Chunk:
    """Documents' units until they make a chunk's rows."""

    def __init__(self, units: Aligned, most: int):
        self.units, self.most = units, most
        self.clear()

    def clear(self) -> None:
        self.docs, self.entries = 0, 0
        self.doc: list[np.ndarray] = []
        self.unit: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        if len(self.units.groups) > TABLE_PIECES or self.units.chars > KEPT_CHARS:
            self.units.reset()

    def full(self) -> bool:
        return self.docs >= self.most or self.entries >= CHUNK_ENTRIES or self.units.chars > KEPT_CHARS

    def together(self, texts: list[str], k: int) -> int:
        """Where the texts end that are taken at a time with text k."""
        left, end = TOGETHER, min(len(texts), k + self.most - self.docs)
        n = k
        while n < end and len(texts[n]) < WINDOW and left > 0:
            left -= len(texts[n])
            n += 1
        return max(n, k + 1)

    def add(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256 of documents, which take the next numbers: short ones, or one alone."""
        groups = self.units.groups.__getitem__
        if len(texts) == 1 and len(texts[0]) >= WINDOW:
            digest, found, between = hashlib.sha256(), [], b""
            for got in self.units.numbers(texts[0]):
                for k in range(0, len(got), 1 << 14):
                    digest.update(between + b"".join(map(groups, got[k : k + (1 << 14)].tolist()))[:-1])
                    between = b";"
                found.append(np.unique(got, return_counts=True))
            unit, back = np.unique(np.concatenate([u for u, _ in found]), return_inverse=True)
            times = np.zeros(len(unit), np.int64)
            np.add.at(times, back, np.concatenate([t for _, t in found]))
            doc, digests = np.zeros(len(unit), np.int64), [digest.hexdigest()]
        else:
            number, first = self.units.learn(texts)
            ordered, first = number.tolist(), first.tolist()
            digests = [hashlib.sha256(b"".join(map(groups, ordered[a:b]))[:-1]).hexdigest() if b > a else "" for a, b in pairwise(first)]
            key, times = np.unique(np.repeat(np.arange(len(texts)) << 32, np.diff(first)) | number, return_counts=True)
            doc, unit = key >> 32, key & 0xFFFFFFFF
        counts = self.units.counts[unit]
        bad = np.zeros(len(texts), bool)
        bad[doc[counts[:, 0] < 0]] = True
        sums = summed(counts * times[:, None], np.searchsorted(doc, np.arange(len(texts)), "right"))
        if bad.any():
            sums[bad] = 0
            digests = ["" if x else d for x, d in zip(bad.tolist(), digests, strict=True)]
            doc, unit, times = (x[~bad[doc]] for x in (doc, unit, times))
        self.doc.append(doc + self.docs)
        self.unit.append(unit)
        self.times.append(times)
        self.docs += len(texts)
        self.entries += len(unit)
        return [(*n, d) for n, d in zip(sums.tolist(), digests, strict=True)]

    def rows(self) -> list[tuple]:
        """(side, pairs, sums, postings of each pair, documents as 16-bit and multiplicities as 32-bit numbers) of the chunk."""
        if not self.entries:
            return []
        doc, unit, times = map(np.concatenate, (self.doc, self.unit, self.times))
        own, back = np.unique(unit, return_inverse=True)
        size = self.units.counts[own, 3]
        flat = np.frombuffer(b"".join(map(self.units.pairs.__getitem__, own.tolist())), "<i8")
        first = np.cumsum(size) - size
        n = size[back]
        at = np.arange(n.sum()) + np.repeat(first[back] - (np.cumsum(n) - n), n)
        codes, place = np.unique(flat, return_inverse=True)
        key = place[at] * CHUNK_DOCS + np.repeat(doc, n)
        order = np.argsort(key)
        key, m = key[order], np.repeat(times, n)[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, m = key[starts], np.add.reduceat(m, starts)
        pair, doc = key // CHUNK_DOCS, (key % CHUNK_DOCS).astype("<u2")
        starts = np.searchsorted(pair, np.arange(len(codes) + 1))
        sums, posted = np.add.reduceat(m, starts[:-1]), np.diff(starts)
        side, out = sides_of(codes), []
        of_posting = side[pair]
        for s in np.unique(side).tolist():
            here, there = side == s, of_posting == s
            out.append((s, codes[here], sums[here], posted[here], doc[there].tobytes(), m[there].astype("<u4").tobytes()))
        return out


def _gathered(docs: DataFrame, a_path: str, b_path: str, chunk_docs: int) -> DataFrame:
    """A row for each document (side null) and one for each chunk and side."""
    kind = id_type(docs)
    fields = {"chunk": "long", "doc": "int", "doc_id": kind, "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "side": "int", "pairs": "array<long>", "sums": "array<long>", "posted": "array<int>", "docs": "binary", "times": "binary"}
    types = dict(chunk=pa.int64(), doc=pa.int32(), n_a=pa.int64(), n_b=pa.int64(), n_groups=pa.int64(), n_links=pa.int64(), groups_sha256=pa.string(), side=pa.int32(), pairs=pa.list_(pa.int64()), sums=pa.list_(pa.int64()), posted=pa.list_(pa.int32()), docs=pa.binary(), times=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(shared_units(a_path, b_path), min(chunk_docs, CHUNK_DOCS))
        number, id_kind = TaskContext.get().partitionId() << 32, None

        def batch_of(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            of = types | {"doc_id": id_kind}
            return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(f), pa.Array) else pa.array(c, of[f]) if c is not None else pa.nulls(n, of[f]) for f in fields], [*fields])

        def ended() -> Iterator[pa.RecordBatch]:
            for row in chunk.rows():
                yield batch_of(chunk=[number], **{k: [v] for k, v in zip(("side", "pairs", "sums", "posted", "docs", "times"), row, strict=True)})
            chunk.clear()

        for batch in batches:
            ids, id_kind, k0, out = batch.column("doc_id"), batch.column("doc_id").type, 0, []

            def documents(k: int) -> pa.RecordBatch:
                cols = dict(zip(("doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*out, strict=True), strict=True))
                return batch_of(chunk=[number] * len(out), doc_id=ids.slice(k0, k - k0), **cols)

            texts = [v.as_py() or "" for v in batch.column("text")]
            k = 0
            while k < len(texts):
                end, first = chunk.together(texts, k), chunk.docs
                out += [(first + d, *x) for d, x in enumerate(chunk.add(texts[k:end]))]
                k = end
                if chunk.full():
                    yield documents(k)
                    yield from ended()
                    number, k0, out = number + 1, k, []
            if out:
                yield documents(len(ids))
        if chunk.docs:
            yield from ended()

    return docs.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields.items()))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, doc, n_best, count_sum of a task's stream: the counts of one range of side ids, then its postings."""
    pairs = counts = best = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            own = row["pairs"].values.to_numpy()
            if row["chunk"].as_py() is None:
                pairs, counts = own, row["sums"].values.to_numpy()
                order = np.argsort(pairs)
                pairs, counts = pairs[order], counts[order]
                starts = np.flatnonzero(np.concatenate([[True], np.diff(pairs >> _BITS) != 0]))
                highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(pairs))))
                best = counts == highest
                continue
            at = np.repeat(np.searchsorted(pairs, own), row["posted"].values.to_numpy())
            doc, times = np.frombuffer(row["docs"].as_buffer(), "<u2"), np.frombuffer(row["times"].as_buffer(), "<u4").astype(np.int64)
            order = np.argsort(doc, kind="stable")
            doc, times, at = doc[order], times[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), row["chunk"].as_py())), pa.array(doc[starts].astype(np.int32)), pa.array(np.add.reduceat(times * best[at], starts)), pa.array(np.add.reduceat(times * counts[at], starts))],
                ["chunk", "doc", "n_best", "count_sum"],
            )


def align(docs: DataFrame, a_tokenizer: str, b_model: str, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = CHUNK_DOCS, task_postings: int = TASK_POSTINGS) -> DataFrame:
    """How each text's tokens by a byte-level tokenizer (A) and by a SentencePiece model (B) cover each other.

    A encodes a space and the text, B the text, to which it adds the space. Returns one row for each input row: doc_id, n_a,
    n_b, n_groups, n_links long, groups_sha256 string (of ``a1,a2|b1;a3|b2,b3``: ids of each group in order), n_best
    long (links whose pair has the highest count of all with its B id, ties included), count_sum long (the pairs'
    counts, over links). A pair's count is the number of links in all rows that hold it.
    Null and empty texts, and those whose tokens of one side don't spell the space and the text, have zeros and ''.
    Special strings in texts are plain text. Very long texts are taken a window at a time; null ids stay null,
    repeated rows count each, an empty table gives an empty one; other columns, whatever they are called, are not read.
    """
    spark = session(docs)
    made = written(_gathered(text_rows(docs, id_col, text_col), a_tokenizer, b_model, chunk_docs), "postings")
    postings = made.filter("side is not null")
    counts = postings.select("side", F.explode(F.arrays_zip("pairs", "sums")).alias("p")).groupBy("side", F.col("p.pairs").alias("pair")).agg(F.sum("p.sums").alias("n"))
    by_side = counts.groupBy("side").agg(F.collect_list(F.struct("pair", "n")).alias("c")).select("side", F.col("c.pair").alias("pairs"), F.col("c.n").alias("sums"))
    # one row for each range: how many tasks share it
    totals = {r.side: r.n for r in postings.groupBy("side").agg(F.sum(F.length("docs") / 2).alias("n")).collect()}
    shares = [max(1, -(-int(totals.get(s, 0)) // task_postings)) for s in range(SIDES)]
    firsts = [sum(shares[:s]) for s in range(SIDES)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("side") + 1)
    kept = ("chunk", "pairs", "sums", "posted", "docs", "times", "task")
    dealt = postings.withColumn("task", of(firsts) + F.pmod(F.xxhash64("chunk"), of(shares).cast("long")).cast("int")).select(*kept)
    before = by_side.withColumn("task", F.explode(F.sequence(of(firsts), of(firsts) + of(shares) - 1)))
    before = before.select(F.lit(None).cast("long").alias("chunk"), "pairs", "sums", F.lit(None).cast("array<int>").alias("posted"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"), "task")
    stream = before.unionByName(dealt).repartitionById(sum(shares), F.col("task")).sortWithinPartitions(F.col("chunk").asc_nulls_first())
    given = stream.drop("task").mapInArrow(_contributions, "chunk long, doc int, n_best long, count_sum long")
    sums = given.groupBy("chunk", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = made.filter("side is null").select("chunk", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.join(sums, ["chunk", "doc"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
