"""Collocations: frequent phrases scored by their weakest cut, with phrases that a longer one explains left out.

Hierarchical pair naming. A text's words become numbers, local to a chunk of documents; each chunk's
distinct words, with their counts, meet those of all chunks, and a frequent word gets a name. A frequent phrase of
k words is then a pair of names, of its first k - 1 words and of its last k - 1: where two neighbours in a chunk both
have names, the pair gets a local number, the distinct pairs of all chunks meet, and so on to the longest phrase. So no
occurrence is ever shuffled, only each chunk's distinct pairs, and an infrequent part ends all that holds it. A name's
pair also points to its two parents, and these to theirs: counts of all beginnings and ends, for the cuts, come down
that way, and a phrase hears of the longer ones from their pointers to it.

Distinct keys meet by ranges of a hash (sides; the more keys, the more of them). Names are numbers without gaps, so
a pair is a number of twice a name's bits, the hash a bijection of those, and a chunk's keys in order of their hash are small
steps; they are shuffled as such, a row for each chunk and side. What comes back to a chunk is a bit for each key,
and steps of names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.common import fixed_columns, session, written

#: Words that end a chunk; a piece is never divided, so one longer than this makes a longer chunk.
CHUNK_WORDS = 1 << 21
#: Bytes of a text split into words at a time.
WINDOW = 1 << 20
#: Keys of all chunks that meet in one side, on average; for few keys, so many are still worth a task.
SIDE_KEYS, LEAST_KEYS = 1 << 21, 1 << 17
#: Bits of a hash that tell its side, and that a word's hash has.
SIDE_BITS, WORD_BITS = 20, 32
#: Parts of a language whose best phrases are found first.
PARTS = 64

#: A-Z as a-z, a tab as a space, what ends a piece as a line's end.
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)
#: Between pieces: a byte that UTF-8 doesn't have.
_BREAK = b"\xff"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Buffer:
    """A language's words of a chunk, as numbers; 0 stands between pieces."""

    def __init__(self):
        self.numbers, self.runs, self.words = _Numbers({_BREAK: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        got = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.runs.append(got)
        self.words += int(np.count_nonzero(got))

    def row(self, chunk: int, lang: str) -> dict:
        seq, words = np.concatenate(self.runs), [*self.numbers][1:]
        counts, order = np.bincount(seq, minlength=len(self.numbers))[1:], _by_hash(words)[0]
        place = np.zeros(len(words) + 1, np.int64)
        place[order + 1] = np.arange(1, len(words) + 1)
        keys = _squeezed(b"\n".join([words[k] for k in order.tolist()]))
        return _chunk_row(chunk, lang, self.words, keys, counts[order], place[seq])


def _by_hash(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of different words by hash, then by themselves, and the hashes in it."""
    h = _word_hashes(words)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = np.flatnonzero(h[1:] == h[:-1]).tolist()
    for k in same:
        if not k or h[k - 1] != h[k]:
            end = int(np.searchsorted(h, h[k], "right"))
            order[k:end] = sorted(order[k:end].tolist(), key=words.__getitem__)
    return order, h


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


_MIX, _MIX2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits (even) that spreads them."""
    mask = np.uint64((1 << bits) - 1)
    x = keys * np.uint64(_MIX) & mask
    return (x ^ x >> np.uint64(bits // 2)) * np.uint64(_MIX2) & mask


def _unmixed(hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    x = hashes * np.uint64(pow(_MIX2, -1, 1 << 64)) & mask
    return (x ^ x >> np.uint64(bits // 2)) * np.uint64(pow(_MIX, -1, 1 << 64)) & mask


def _squeezed(data: bytes) -> bytes:
    """The bytes, compressed if that is worth it."""
    if len(data) < 256:
        return b"\0" + data
    return b"\1" + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _released(data: bytes) -> bytes:
    return data[1:] if data[0] == 0 else pa.decompress(data[9:], decompressed_size=int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 by planes of bytes, as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + _squeezed(planes.T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_released(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _steps(values: np.ndarray, low: int = 0) -> bytes:
    """Ascending numbers from ``low``."""
    return _packed(np.diff(values, prepend=values.dtype.type(low)))


def _walked(data: bytes, low: int = 0) -> np.ndarray:
    return np.cumsum(_unpacked(data).astype(np.uint64), dtype=np.uint64) + np.uint64(low)


def _chunk_row(chunk: int, lang: str, total: int, keys: bytes, counts: np.ndarray, seq: np.ndarray) -> dict:
    """A chunk whose sequence has the places of its keys (from 1); kept are their numbers by falling count, which are small."""
    number = np.zeros(len(counts) + 1, np.int64)
    number[_by_count(counts) + 1] = np.arange(1, len(counts) + 1)
    return dict(chunk=chunk, lang=lang, total=total, n=len(counts), keys=keys, counts=_packed(counts), seq=_packed(number[seq]))


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")


def _windows(text: str) -> Iterator[list[bytes]]:
    """The words of a text and breaks, a window at a time; one that ends within a piece doesn't end with a break."""
    data, at = text.encode().translate(_BYTES), 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            found = [k for k in (data.find(b" ", end), data.find(b"\n", end)) if k >= 0]
            end = min(found) if found else len(data)
        yield data[at:end].replace(b"\n", b" " + _BREAK + b" ").split()
        at = end


_CHUNK = "chunk long, lang string, total long, n int, keys binary, counts binary, seq binary"
_DEALT = "side int, chunk long, lang string, first int, n int, keys binary, counts binary"
_NAMED = "side int, chunk long, first int, n int, flags binary, ranks binary, rank int, f long, lang string, word string, left long, right long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    """Columns by name; those not given are null."""
    kinds = dict(c.split(" ") for c in schema.split(", "))
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k]) for c, k in kinds.items()], [*kinds])


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    return _batch({c: [r[c] for r in rows] for c in rows[0]}, schema)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_words: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    buffers: dict[str, _Buffer] = {}

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang, b in buffers.items():
            if len(b.numbers) > 1:
                yield _rows([b.row(number, lang)], _CHUNK)
                number += 1
        buffers.clear()

    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for words in _windows(text.as_py()):
                if held >= chunk_words and _BREAK in words:
                    # a long text goes on in the next chunk, from the end of a piece
                    k = words.index(_BREAK)
                    buffers.setdefault(lang, _Buffer()).add(words[:k])
                    words, held = words[k:], 0
                    yield from ended()
                if words:
                    buffers.setdefault(lang, _Buffer()).add(words)
                    held += len(words)
            if lang in buffers:
                buffers[lang].add([_BREAK])
            if held >= chunk_words:
                held = 0
                yield from ended()
    yield from ended()


def _dealt(batches: Iterator[pa.RecordBatch], sides: int, bits: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each side of a chunk's keys; bits is null for words."""
    for batch in batches:
        for row in batch.to_pylist():
            if bits is None:
                words = _released(row["keys"]).split(b"\n")
                top = _word_hashes(words) >> np.uint64(WORD_BITS - SIDE_BITS)
            else:
                hashes = _walked(row["keys"])
                top = hashes >> np.uint64(bits - SIDE_BITS)
            side, counts, out = (top * np.uint64(sides) >> np.uint64(SIDE_BITS)).astype(np.int64), _unpacked(row["counts"]), []
            starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]])).tolist()
            for a, b in zip(starts, [*starts[1:], len(side)], strict=True):
                s = int(side[a])
                keys = _squeezed(b"\n".join(words[a:b])) if bits is None else _steps(hashes[a:b], _low(s, sides, bits))
                out.append(dict(side=s, chunk=row["chunk"], lang=row["lang"], first=a, n=b - a, keys=keys, counts=_packed(counts[a:b] - 1)))
            yield _rows(out, _DEALT)


def _low(side: int, sides: int, bits: int) -> int:
    """The least hash of a side."""
    return -(-(side << SIDE_BITS) // sides) << bits - SIDE_BITS


def _merged(batches: Iterator[pa.RecordBatch], sides: int, bits: int | None, bases: np.ndarray | None, least: int) -> Iterator[pa.RecordBatch]:
    """Of a side's frequent keys a row each, and of each chunk that has such a row with a bit for each of its keys and their ranks."""
    rows, keys, counts = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            keys.append(row["keys"] if bits is None else _walked(row["keys"], _low(row["side"], sides, bits)))
            counts.append(_unpacked(row["counts"]) + 1)
            rows.append({c: row[c] for c in ("side", "chunk", "lang", "first", "n")})
    if not rows:
        return
    of_lang: dict[str, _Numbers] = {}
    if bits is None:
        order = sorted(range(len(rows)), key=lambda k: rows[k]["lang"])
        rows, keys, counts = ([x[k] for k in order] for x in (rows, keys, counts))
        at, before = [], {}
        for row, data in zip(rows, keys, strict=True):
            if row["lang"] not in of_lang:
                before[row["lang"]] = sum(map(len, of_lang.values()))
                of_lang[row["lang"]] = _Numbers()
            words = _released(data).split(b"\n")
            at.append(np.fromiter(map(of_lang[row["lang"]].__getitem__, words), np.int64, len(words)) + before[row["lang"]])
        at, n = np.concatenate(at), sum(map(len, of_lang.values()))
        order = np.concatenate([_by_hash([*d])[0] + before[lang] for lang, d in of_lang.items()])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        at = place[at]
    else:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = len(distinct)
    del keys
    # whole numbers, added exactly
    total = np.zeros(n, np.int64)
    np.add.at(total, at, np.concatenate(counts))
    often = total >= least
    rank, found = np.cumsum(often) - 1, np.flatnonzero(often)
    side, a, out = rows[0]["side"], 0, []
    for row in rows:
        own = at[a : a + row["n"]]
        a += row["n"]
        flags = often[own]
        if flags.any():
            out.append(dict(side=side, chunk=row["chunk"], first=row["first"], n=row["n"], flags=_squeezed(np.packbits(flags).tobytes()), ranks=_steps(rank[own[flags]])))
        if len(out) == 256:
            yield _rows(out, _NAMED)
            out = []
    if out:
        yield _rows(out, _NAMED)
    if bits is None:
        words = [(lang, w) for lang, d in of_lang.items() for w in d]
        shown = [words[k] for k in order[found].tolist()]
    else:
        pair = _unmixed(distinct[found], bits)
        half = np.uint64(bits // 2)
        left, right = (_names(x.astype(np.int64), bases) for x in (pair >> half, pair & np.uint64((1 << bits // 2) - 1)))
    for k in range(0, len(found), 1 << 14):
        part = slice(k, k + (1 << 14))
        f = total[found[part]]
        what = dict(lang=[x for x, _ in shown[part]], word=[w.decode() for _, w in shown[part]]) if bits is None else dict(left=left[part], right=right[part])
        yield _batch(dict(side=[side] * len(f), rank=np.arange(k, k + len(f)), f=f, **what), _NAMED)


def _names(numbers: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Names, which are a side and a rank, from numbers without gaps."""
    side = np.searchsorted(bases, numbers, "right") - 1
    return side << 32 | numbers - bases[side]


def _paired(batches: Iterator[pa.RecordBatch], bases: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's neighbouring pairs of names, as new keys."""
    for batch in batches:
        for row in batch.to_pylist():
            name = np.zeros(row["n"], np.int64)
            for x in row["found"]:
                flags = np.unpackbits(np.frombuffer(_released(x["flags"]), np.uint8), count=x["n"])
                name[x["first"] + np.flatnonzero(flags)] = _walked(x["ranks"]).astype(np.int64) + bases[x["side"]] + 1
            seq = np.concatenate([[0], name[_by_count(_unpacked(row["counts"]))]])[_unpacked(row["seq"])]
            both = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
            if not len(both):
                continue
            pair = (seq[both] - 1).astype(np.uint64) << np.uint64(bits // 2) | (seq[both + 1] - 1).astype(np.uint64)
            keys, place, counts = np.unique(_mixed(pair, bits), return_inverse=True, return_counts=True)
            after = np.zeros(len(seq) - 1, np.int64)
            after[both] = place + 1
            yield _rows([_chunk_row(row["chunk"], row["lang"], 0, _steps(keys), counts, after)], _CHUNK)


def _named(chunks: DataFrame, name: str, bits: int | None, bases: np.ndarray | None, least: int, side_keys: int) -> tuple[DataFrame, np.ndarray]:
    """What ``_merged`` says of all chunks' keys, and how many names there are before each side's."""
    spark = chunks.sparkSession
    n = chunks.agg(F.sum("n")).first()[0] or 0
    sides = max(1, -(-n // side_keys), min(spark.sparkContext.defaultParallelism, n // LEAST_KEYS))
    if sides >> SIDE_BITS:
        raise ValueError("too many phrases for their sides")
    dealt = chunks.select("chunk", "lang", "keys", "counts").mapInArrow(partial(_dealt, sides=sides, bits=bits), _DEALT)
    merge = partial(_merged, sides=sides, bits=bits, bases=bases, least=least)
    named = written(dealt.repartitionById(sides, F.col("side")).mapInArrow(merge, _NAMED), name)
    found = np.zeros(sides + 1, np.int64)
    for r in named.filter("f is not null").groupBy("side").count().collect():  # a row for each side
        found[r.side + 1] = r["count"]
    return named, np.cumsum(found)


def _next(chunks: DataFrame, named: DataFrame, bases: np.ndarray, bits: int) -> DataFrame:
    """The chunks at the next length of phrase; a chunk has a row for each side."""
    own = named.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("side", "first", "n", "flags", "ranks")).alias("found"))
    return chunks.select("chunk", "lang", "n", "counts", "seq").join(own, "chunk").mapInArrow(partial(_paired, bases=bases, bits=bits), _CHUNK)


def _cuts(words: int) -> Column:
    """The lowest-scoring cut of a phrase: score, first words, l, r."""
    whole = F.lit(2_000_000).cast("decimal(20,0)") * F.col("f").cast("decimal(18,0)")

    def cut(k: int) -> Column:
        l, r = F.col("pre")[k - 1], F.col("suf")[words - k - 1]
        # exact: the quotient's places after the point are cut off from a whole number of 38 digits
        score = F.call_function("div", whole, (l + r).cast("decimal(19,0)"))
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*map(cut, range(1, words))))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", chunk_words: int = CHUNK_WORDS, side_keys: int = SIDE_KEYS) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language.

    Texts are brought to lower case (A-Z), cut into pieces at ``.,;:!?`` and ends of lines, and into words at spaces
    and tabs. f counts a phrase's occurrences within pieces of its language, n all words of it. Of a phrase with
    a = f >= least, each cut into first words (l = f) and rest (r = f) has the score floor(2000000 * a / (l + r)); the lowest counts,
    of equal ones the first. A phrase within a longer frequent one goes if 100 * f(longer) >= percent * a. Returns for each language
    the first ``top`` by score, a (both descending) and phrase (by its bytes): lang, rank (from 1), phrase, a, l, r, n, score long.
    Null texts are empty and a null language is ``und``; repeated rows count each time, texts of any length are taken whole; an empty
    table gives an empty one; other columns, whatever they are called, are not read.
    """
    session(docs)
    rows = fixed_columns(docs, lang_col, text_col).toDF("lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = chunks = written(rows.mapInArrow(partial(_chunks, chunk_words=chunk_words), _CHUNK), "chunks")
    named, bases = _named(chunks, "words", None, None, least, side_keys)
    called = (F.shiftleft(F.col("side").cast("long"), 32) + F.col("rank")).alias("name")
    names = named.filter("f is not null").select(called, "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<long>").alias("pre"), F.array().cast("array<long>").alias("suf"))
    found: list[DataFrame] = []
    for words in range(2, longest + 1):
        bits = 2 * max(SIDE_BITS // 2, int(bases[-1]).bit_length())
        if bits > 64:
            raise ValueError("too many frequent phrases for their numbers")
        chunks = written(_next(chunks, named, bases, bits), f"pairs-{words}")
        named, bases = _named(chunks, f"phrases-{words}", bits, bases, least, side_keys)
        pairs = named.filter("f is not null").select(called, "left", "right", "f")
        if found:
            longer = pairs.select(F.explode(F.array("left", "right")).alias("name"), F.col("f").alias("g")).groupBy("name").agg(F.max("g").alias("g"))
            found[-1] = _kept(found[-1].join(longer, "name", "left"), words - 1, percent)
        left = names.select(F.col("name").alias("left"), "lang", "phrase", F.concat("pre", F.array("f")).alias("pre"))
        right = names.select(F.col("name").alias("right"), "last", F.concat("suf", F.array("f")).alias("suf"))
        joined = pairs.join(left, "left").join(right, "right")
        names = written(joined.select("name", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "pre", "suf"), f"names-{words}")
        found.append(names)
    found[-1] = _kept(found[-1].withColumn("g", F.lit(None).cast("long")), longest, percent)
    candidates = found[0]
    for f in found[1:]:
        candidates = candidates.unionByName(f)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of each part of a language first, so that a language's last task has at most PARTS * top rows
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = candidates.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "part")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = first.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _kept(phrases: DataFrame, words: int, percent: int) -> DataFrame:
    """Phrases that no longer one explains, with their cut; g is the highest count of a longer one."""
    wide = lambda c, k: F.col(c).cast("decimal(18,0)") * F.lit(k).cast("decimal(10,0)")
    kept = phrases.filter(F.col("g").isNull() | (wide("g", 100) < wide("f", percent)))
    return kept.withColumn("cut", _cuts(words)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


#: DuckDB SQL for ``collocations`` with its defaults over documents.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, f, w, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, c, p.f AS l, s.f AS r, 2000000::HUGEINT * cuts.f // (p.f + s.f) AS score
  FROM cuts JOIN counts p ON p.lang = cuts.lang AND p.phrase = array_to_string(w[1:c], ' ') AND p.k = c
  JOIN counts s ON s.lang = cuts.lang AND s.phrase = array_to_string(w[c + 1:], ' ') AND s.k = cuts.k - c),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ones AS (
  SELECT lang, f, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k),
longer AS (SELECT lang, phrase, max(f) AS g FROM inner_ones GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN longer USING (lang, phrase) WHERE g IS NULL OR 100 * g < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
