"""Scoring by prediction by partial matching over bytes, beside a word unigram base.

The model is a byte-context trie of order 5: for each context of up to five symbols, the counts of the
symbols that follow. Symbols are bytes and a boundary that stands before and after each text. Escape is
estimated by method C: a context seen T times with D different symbols escapes with D / (T + D). After an
escape, the symbols of the context that was left are excluded in the shorter one; below the empty
context, what is left of the alphabet is uniform. A text's code length is the sum over its symbols,
its end included, so that the probabilities of all texts add up to one.

The trie is counted over all training texts: each task reduces its texts to distinct 6-grams, Spark sums
these by key. Since symbols that follow a context also follow its suffixes, what must be excluded is
known from the context that was left alone, so the cost of a symbol depends on its 6-gram alone: that of
one in the trie on the counts of its context, that of another on a chain of escapes.

Texts are gone through once, whatever the size of the trie. The costs of the most frequent 6-grams, at
most ``MOST_NODES``, are broadcast; all others are given out once for each text and joined with their
costs. 6-grams that the trie lacks are priced first, each once: they meet the nodes that decide them in
shards of contexts with a common end, at most ``SHARD_NODES`` nodes each. A context's end is taken as long
as that needs; what shorter contexts a shard needs besides, at most 257 counts for each, goes with it.

Word counts for the base: words that are frequent enough to number at most ``MOST_WORDS`` are
broadcast, all others are joined by a shuffle.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.common import fold_of, session, text_rows, written
from leadline.llm.words import STRETCH, mix, text_bytes, words_of

ORDER, EDGE, BITS = 5, 256, 9
ALPHABET = 257
#: Most 6-grams and words that are broadcast, nodes of the trie in a shard, and 6-grams that are priced together.
MOST_NODES, MOST_WORDS, SHARD_NODES, SHARD_KEYS = 1 << 20, 1 << 19, 1 << 18, 1 << 20


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << BITS * symbols) - 1)


def grams_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, keys, offsets): the 6-gram keys of texts lo to hi - 1; a long text comes in several parts."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= STRETCH:
            hi += 1
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= STRETCH:
            size = np.diff(offsets[lo : hi + 1])
            to = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
            sym = np.full(to[-1], EDGE, np.uint64)
            keep = np.ones(to[-1], bool)
            text = np.repeat(np.arange(hi - lo), size)
            sym[np.arange(b - a) + (ORDER + 1) * text + ORDER] = data[a:b]
            for k in range(ORDER):
                keep[to[:-1] + k] = False
            yield lo, hi, _keys(sym)[keep[ORDER:]], np.concatenate([[0], np.cumsum(size + 1)])
        else:
            for x in range(a, b, STRETCH):
                y = min(x + STRETCH, b)
                before = data[max(a, x - ORDER) : x]
                sym = np.concatenate([np.full(ORDER - len(before), EDGE, np.uint64), before.astype(np.uint64), data[x:y].astype(np.uint64), np.full(int(y == b), EDGE, np.uint64)])
                keys = _keys(sym)
                yield lo, hi, keys, np.array([0, len(keys)])
        lo = hi


def _keys(sym: np.ndarray) -> np.ndarray:
    n = len(sym) - ORDER
    out = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(BITS)) | sym[k : k + n]
    return out


class Tally:
    """Counts of 64-bit keys. Repeats are merged as they pile up; past ``most`` different keys, counts are given out."""

    def __init__(self, most: int = 1 << 20):
        self.raw, self.waiting, self.most = [], 0, most
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting < self.most:
            return None
        self.merge()
        return self.take() if len(self.keys) >= self.most else None

    def merge(self) -> None:
        if self.raw:
            k, c = np.unique(np.concatenate(self.raw), return_counts=True)
            self.raw, self.waiting = [], 0
            self.keys, self.counts = _summed(np.concatenate([self.keys, k]), np.concatenate([self.counts, c]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.counts
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def _counted(rows: DataFrame) -> DataFrame:
    """kind (0: word, 1: 6-gram), key and count from each task's texts."""

    def rows_of(kind: int, got: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        keys, counts = got or ((), ())
        for k in range(0, len(keys), 1 << 16):
            own = keys[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int8)), pa.array(own.view(np.int64)), pa.array(counts[k : k + (1 << 16)].astype(np.int64))], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, nodes = Tally(), Tally()
        for batch in batches:
            column = batch.column("text")
            for _, _, h, _ in words_of(column):
                yield from rows_of(0, words.add(h))
            for _, _, keys, _ in grams_of(*text_bytes(column)):
                yield from rows_of(1, nodes.add(keys))
        yield from rows_of(0, words.take())
        yield from rows_of(1, nodes.take())

    return rows.mapInArrow(run, "kind byte, key long, n long")


class Table:
    """Numbers by 64-bit key, found by whole arrays: an open hash table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            if len(at) and at.max() >= len(self.slots):
                self.slots = np.append(self.slots, np.full(1024, -1, np.int32))
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1
        self.slots = np.append(self.slots, np.full(64, -1, np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it isn't there."""
        at = self._home(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(wrong):
            at[wrong] += 1
            out[wrong] = got = self.slots[at[wrong]]
            wrong = wrong[(self.keys[got] != keys[wrong]) & (got >= 0)]
        return out


class Model:
    """Costs of escapes and symbols, in log10, for the contexts of one shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: dict[int, tuple[np.ndarray, np.ndarray]]):
        """keys, counts: the shard's 6-grams; low: the grams of the orders that these don't decide, at least of 0 and 1."""
        grams = {ORDER: (keys, counts)} | low
        for k in range(ORDER - 1, -1, -1):
            if k not in low:
                grams[k] = _summed(grams[k + 1][0] & _mask(k + 1), grams[k + 1][1])
        self.gram = {k: Table(g) for k, (g, _) in grams.items()}
        self.count = {k: c.astype(np.float64) for k, (_, c) in grams.items()}
        self.context: dict[int, Table] = {}
        self.total: dict[int, np.ndarray] = {}
        self.leave: dict[int, np.ndarray] = {}
        self.share: dict[int, np.ndarray] = {}
        self.pass_on: dict[int, np.ndarray] = {}
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(ORDER + 1):
            g, c = grams[k]
            ctx, first = np.unique(g >> np.uint64(BITS), return_index=True)
            t = np.add.reduceat(c, first).astype(np.float64) if len(first) else np.empty(0)
            d = np.diff(np.append(first, len(g))).astype(np.float64)
            self.context[k], seen[k] = Table(ctx), (t, d)
            self.total[k] = t + d
            self.leave[k] = -np.log10(d / (t + d)) if len(d) else np.empty(0)
            if k:
                at = self.context[k - 1].find(ctx & _mask(k - 1))
                taken = self.count[k - 1][self.gram[k - 1].find(g & _mask(k))]
                taken = np.add.reduceat(taken, first) if len(first) else np.empty(0)
                t_left, d_left = seen[k - 1][0][at] - taken, seen[k - 1][1][at] - d
                self.share[k] = t_left + d_left
                self.pass_on[k] = np.where(d_left > 0, -np.log10(np.maximum(d_left, 1) / np.maximum(t_left + d_left, 1)), 0.0)
        self.rest = np.log10(ALPHABET - len(grams[0][0])) if len(grams[0][0]) < ALPHABET else 0.0
        top = self.total[ORDER][self.context[ORDER].find(keys >> np.uint64(BITS))] if len(keys) else np.empty(0)
        self.best = (-np.log10(counts / top) if len(keys) else np.empty(0)).astype(np.float32)
        del self.count[ORDER], self.total[ORDER]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each symbol in its context."""
        at = self.gram[ORDER].find(keys)
        out = self.best[at].astype(np.float64) if len(self.best) else np.zeros(len(keys))
        open_ = np.flatnonzero(at < 0)
        key = keys[open_]
        cost = np.zeros(len(key))
        left = self.context[ORDER].find(key >> np.uint64(BITS))  # the context that was escaped from, -1: none yet
        cost[left >= 0] += self.leave[ORDER][left[left >= 0]]
        active = np.arange(len(key))
        for k in range(ORDER - 1, -1, -1):
            g = key[active] & _mask(k + 1)
            here = self.context[k].find(g >> np.uint64(BITS))
            hit = self.gram[k].find(g)
            came = left[active] >= 0
            got = (hit >= 0) & (came | (here >= 0))
            x, first = got & came, got & ~came
            cost[active[x]] -= np.log10(self.count[k][hit[x]] / self.share[k + 1][left[active[x]]])
            cost[active[first]] -= np.log10(self.count[k][hit[first]] / self.total[k][here[first]])
            x, first = ~got & came, ~got & ~came & (here >= 0)
            cost[active[x]] += self.pass_on[k + 1][left[active[x]]]
            cost[active[first]] += self.leave[k][here[first]]
            left[active] = here
            active = active[~got]
        cost[active] += self.rest if len(self.total[0]) else np.log10(ALPHABET)
        out[open_] = cost
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(key, n) of a frame whose size is bounded."""
    t = df.select("key", "n").toArrow()
    return t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()


def _suffix(keys: np.ndarray, depth: int) -> np.ndarray:
    """The last symbols of each key's context."""
    return (keys >> np.uint64(BITS)) & _mask(depth)


class Shards:
    """Which shard a 6-gram belongs to, by the end of its context.

    Ends of two symbols are dealt to shards in order until one is full; an end that has more nodes than a shard may
    hold is divided by one symbol more, and so on. Of an end that is divided, ``low`` keeps its own counts.
    """

    def __init__(self, nodes: DataFrame, most: int):
        self.ends: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by depth: ends in order, the shard of each (-1: divided), and the first shard under it
        self.above: list[tuple[int, int]] = []  # of each shard: depth of its ends, and the end above them
        self.low: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by order: keys and counts under the ends that are divided
        divided: np.ndarray | None = None
        for depth in range(2, ORDER + 1):
            end = F.shiftright(F.col("key"), BITS).bitwiseAND(F.lit(int(_mask(depth))))
            here = nodes if divided is None else nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(pa.table({"up": divided.view(np.int64)}))), F.col("up") == end.bitwiseAND(F.lit(int(_mask(depth - 1)))))
            got = here.groupBy(end.alias("end")).agg(F.count("*").alias("n")).toArrow()  # 257 * 257 rows, or 257 for each end that was divided
            ends, sizes = got.column("end").to_numpy().view(np.uint64), got.column("n").to_numpy()
            up = ends & _mask(depth - 1) if depth > 2 else np.zeros(len(ends), np.uint64)
            order = np.lexsort((ends, up))
            ends, sizes, up = ends[order], sizes[order], up[order]
            shard, held, before = np.empty(len(ends), np.int64), 0, None
            large: list[int] = []
            for i in range(len(ends)):
                if sizes[i] > most and depth < ORDER:
                    large.append(i)
                    continue
                if before != up[i] or held + sizes[i] > most or not self.above:
                    self.above.append((depth, int(up[i])))
                    before, held = up[i], 0
                shard[i], held = len(self.above) - 1, held + sizes[i]
            shard[large] = -1
            by_end = np.argsort(ends, kind="stable")
            self.ends[depth] = ends[by_end], shard[by_end], shard[by_end].copy()
            if not large:
                break
            divided = ends[large]
            up_to = F.col("key").bitwiseAND(F.lit(int(_mask(depth + 1))))
            frame = nodes.sparkSession.createDataFrame(pa.table({"up": divided.view(np.int64)}))
            self.low[depth] = _sorted(*_arrays(nodes.join(F.broadcast(frame), F.col("up") == end).groupBy(up_to.alias("key")).agg(F.sum("n").alias("n"))))
        if not self.above:
            self.above.append((2, 0))
        for k in range(len(self.above) - 1, -1, -1):  # the first shard of all counts in the end
            for depth in range(2, self.above[k][0]):
                ends, _, first = self.ends[depth]
                first[np.searchsorted(ends, np.uint64(self.above[k][1] & int(_mask(depth))))] = k

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each key. One whose context has an end that no node has goes to any shard under the longest end that nodes have."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for depth, (ends, shard, first) in self.ends.items():
            end = _suffix(keys[open_], depth)
            at = np.searchsorted(ends, end)
            here = at < len(ends)
            here[here] = ends[at[here]] == end[here]
            open_, at = open_[here], at[here]
            out[open_] = first[at]
            open_ = open_[shard[at] < 0]
        return out

    def low_of(self, shard: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The grams of orders 2 and more that the shard's nodes don't decide."""
        depth, up = self.above[shard]
        out = {}
        for k in range(2, depth):
            keys, counts = self.low[k]
            mine = _suffix(keys, k) == np.uint64(up & int(_mask(k)))
            out[k] = keys[mine], counts[mine]
        return out


def _priced(keys: DataFrame, nodes: DataFrame, low: dict[int, tuple[np.ndarray, np.ndarray]], shard_nodes: int, shard_keys: int) -> DataFrame:
    """(key, cost) of 6-grams that the trie lacks: each shard's nodes make a model, which prices the keys of the shard."""
    spark = nodes.sparkSession
    shards = spark.sparkContext.broadcast(Shards(nodes, shard_nodes))
    below = spark.sparkContext.broadcast(low)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shards.value.of(batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], ["shard", *batch.schema.names])

    keys = keys.mapInArrow(dealt, "shard long, key long")
    # a shard with many keys is priced in parts, each with the shard's nodes
    parts = keys.groupBy("shard").agg(F.ceil(F.count("*") / shard_keys).cast("int").alias("parts"))
    keys = keys.join(F.broadcast(parts), "shard").select("shard", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key")
    nodes = nodes.select("key", "n").mapInArrow(dealt, "shard long, key long, n long").join(F.broadcast(parts), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "n")

    def price(group: tuple, asked: pa.Table, of: pa.Table) -> pa.Table:
        own = _sorted(of.column("key").to_numpy().view(np.uint64), of.column("n").to_numpy())
        k = asked.column("key").to_numpy().view(np.uint64)
        model = Model(*own, below.value | shards.value.low_of(group[0].as_py()))
        return pa.table({"key": pa.array(k.view(np.int64)), "cost": pa.array(model.costs(k))})

    return keys.groupBy("shard", "part").cogroup(nodes.groupBy("shard", "part")).applyInArrow(price, "key long, cost double")


def _frequent(table: DataFrame, most: int) -> int:
    """The least count, a power of two, that at most so many rows of (key, n) have or exceed."""
    levels = {r.level: r.n for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    least, so_far = max(levels, default=0) + 1, 0
    while least > 0 and so_far + levels.get(least - 1, 0) <= most:
        least -= 1
        so_far += levels.get(least, 0)
    return 2**least


def score_texts(docs: DataFrame, learn: str = "fold != 1", folds: int = 5, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES, most_words: int = MOST_WORDS, shard_nodes: int = SHARD_NODES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """log10 probability of every whole text under the trie learnt from the texts of the training folds.

    ``learn`` is a condition on fold = crc32(id as text) mod folds; texts without an id are not learnt from.
    Returns one row for each input row: doc_id, held_out boolean, n_tokens long (words and one end), n_known
    long, train_tokens long, base_score double (word unigrams with half a count added), score double, n_bytes long.
    Null and empty texts have one token, the end, and the cost of an end after the boundary; very long texts are
    taken whole, in stretches. With nothing to learn from, bytes are uniform and every base term is
    log10(0.5 / 0.5). Repeated rows give repeated results, a null id stays null with held_out false, an empty
    table gives an empty one; other columns, whatever they are called, are not read.
    """
    spark = session(docs)
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    train = rows.withColumn("fold", fold_of("doc_id", folds)).filter(learn)
    counted = written(_counted(train.select("text")).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words, grams = counted.filter("kind = 0").select("key", "n"), counted.filter("kind = 1").select("key", "n")
    n_docs = train.count()
    got = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (got.n or 0) + n_docs, got.v + (n_docs > 0)
    below = float(total + 0.5 * (distinct + 1))
    end_part = float(np.log10((n_docs + 0.5) / below))

    # a context is followed by 257 symbols at most
    context = Window.partitionBy(F.shiftright(F.col("key"), BITS))
    nodes = written(grams.select("key", "n", (-F.log10(F.col("n") / (F.sum("n").over(context) + F.count("*").over(context)))).cast("float").alias("cost")), "nodes")
    least_word, least_node = _frequent(words, most_words), _frequent(nodes, most_nodes)
    frequent = nodes.filter(F.col("n") >= least_node).select("key", "cost").toArrow()
    known = spark.sparkContext.broadcast((*_sorted(frequent.column("key").to_numpy().view(np.uint64), frequent.column("cost").to_numpy()), *_sorted(*_arrays(words.filter(F.col("n") >= least_word)))))
    parts = written(_part(rows, kind, known, below), "parts")

    # what was not known: each 6-gram and word is looked up once
    rest = parts.filter("not main")
    asked = written(rest.filter("gram").select(F.col("word").alias("key")).distinct().join(nodes.filter(F.col("n") < least_node).select("key", "cost"), "key", "left"), "asked")
    pairs = _sorted(*_arrays(nodes.groupBy(F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("key")).agg(F.sum("n").alias("n"))))
    low = {1: pairs, 0: _summed(pairs[0] & _mask(1), pairs[1])}
    novel = _priced(asked.filter("cost is null").select("key"), nodes, low, shard_nodes, shard_keys)
    prices = asked.filter("cost is not null").select("key", F.col("cost").cast("double").alias("cost")).unionByName(novel)
    prices = prices.select(F.lit(True).alias("gram"), F.col("key").alias("word"), "cost", F.lit(0).cast("long").alias("c"))
    prices = prices.unionByName(words.filter(F.col("n") < least_word).select(F.lit(False).alias("gram"), F.col("key").alias("word"), F.lit(0.0).alias("cost"), F.col("n").alias("c")))
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))
    found = rest.join(prices, ["gram", "word"], "left").groupBy("doc_id", "mark").agg(
        F.lit(0).cast("long").alias("copies"),
        F.lit(0).cast("long").alias("tokens"),
        F.sum(F.when(~F.col("gram") & (F.col("c") > 0), F.col("times")).otherwise(0)).cast("long").alias("known"),
        F.sum(F.when(F.col("gram"), 0.0).otherwise(term * F.col("times"))).alias("base"),
        F.sum(F.when(F.col("gram"), F.col("cost") * F.col("times")).otherwise(0.0)).alias("score"),
        F.lit(0).cast("long").alias("bytes"),
    )
    columns = ["doc_id", "mark", "copies", "tokens", "known", "base", "score", "bytes"]
    sums = parts.filter("main").select(columns).unionByName(found.select(columns)).groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in columns[2:]])
    # rows that repeat an id and a text were summed; each gets its share
    share = lambda c: (F.col(c) / F.col("copies")).cast("long")
    return sums.withColumn("fold", fold_of("doc_id", folds)).select(
        "doc_id",
        F.coalesce(~F.expr(learn), F.lit(False)).alias("held_out"),
        (share("tokens") + 1).alias("n_tokens"),
        (share("known") + int(n_docs > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + F.lit(end_part)).alias("base_score"),
        (-F.col("score") / F.col("copies")).alias("score"),
        share("bytes").alias("n_bytes"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], counts[order]


#: The table that this worker has made of the broadcast costs, by name.
_tables: dict[str, Table] = {}


def _part(rows: DataFrame, kind: str, known, below: float) -> DataFrame:
    """A main row for each text, with what the frequent 6-grams and words give; a row for each other 6-gram and word of it."""
    names = ["doc_id", "mark", "main", "gram", "word", "times", "copies", "tokens", "known", "base", "score", "bytes"]
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, costs, known_words, known_counts = known.value
        if name not in _tables:
            _tables.clear()
            _tables[name] = Table(keys)
        table = _tables[name]
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_bytes(column)
            n = len(column)
            mark = np.array([zlib.crc32(data[offsets[i] : offsets[i + 1]]) << 31 ^ int(offsets[i + 1] - offsets[i]) for i in range(n)], np.int64)
            score, base, tokens, hits = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            rest: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]] = []  # is a 6-gram, text, key, times
            for lo, hi, own, to in grams_of(data, offsets):
                at = table.find(own)
                cost = np.where(at >= 0, costs[at], 0.0) if len(costs) else np.zeros(len(own))
                score[lo:hi] += np.add.reduceat(cost, to[:-1])
                lost = np.flatnonzero(at < 0)
                if len(lost):
                    rest.append((True, *_runs(np.searchsorted(to, lost, "right") - 1 + lo, own[lost])))
            for lo, _, h, to in words_of(column):
                text = np.repeat(np.arange(len(to) - 1), np.diff(to)) + lo
                text, w, times = _runs(text, h)
                np.add.at(tokens, text, times)
                at = np.searchsorted(known_words, w)
                at[at == len(known_words)] = 0
                hit = known_words[at] == w if len(known_words) else np.zeros(len(w), bool)
                np.add.at(hits, text[hit], times[hit])
                np.add.at(base, text[hit], np.log10((known_counts[at[hit]] + 0.5) / below) * times[hit])
                if not hit.all():
                    rest.append((False, text[~hit], w[~hit], times[~hit]))
            ids = batch.column("doc_id")
            zero = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(mark), pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool)), zero, zero, pa.array(np.ones(n, np.int64)), pa.array(tokens), pa.array(hits), pa.array(base), pa.array(score), pa.array(np.diff(offsets))], names)
            for gram, text, key, times in rest:
                for k in range(0, len(key), 1 << 16):
                    d, w, t = text[k : k + (1 << 16)], key[k : k + (1 << 16)], times[k : k + (1 << 16)]
                    zero, none = pa.array(np.zeros(len(d), np.int64)), pa.array(np.zeros(len(d)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(mark[d]), pa.array(np.zeros(len(d), bool)), pa.array(np.full(len(d), gram)), pa.array(w.view(np.int64)), pa.array(t.astype(np.int64)), zero, zero, zero, none, none, zero], names)

    return rows.mapInArrow(run, f"doc_id {kind}, mark long, main boolean, gram boolean, word long, times long, copies long, tokens long, known long, base double, score double, bytes long")


def _runs(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different (text, key) once, with how often it is there."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.empty(0, np.int64)
    return text[new], keys[new], np.diff(np.append(new, len(keys)))
