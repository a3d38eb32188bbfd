"""Self-join on word n-gram sets by Jaccard similarity, with adaptive multi-match prefixes.

Texts become sets of 64-bit shingle hashes; equal sets are one class, joined through its smallest
document. Shingles are ordered rarest first. If two sets share at least o shingles, their prefixes of
n - o + l shingles share at least l. Every set publishes an index prefix for the largest l; each picks
the l of its own probe prefix by estimated cost: postings read plus candidates to verify, which a
longer prefix makes fewer as it asks for more shared shingles.

Frequencies that give the order and the cost are counted over all documents into a table of 2**21
buckets, so it is broadcast with a known size; any order is right, a coarse one only costs more.

Postings of one shingle are joined as pairs while they are few (``SMALL``). Longer ones, such as those
of thousands of near copies, first link everything to the most central member, which is verified and
makes components; then only members of different components are compared: those outside the list's
largest component visit the blocks, of bounded size, of all members whose sets are near enough in size,
by a 128-place histogram whose L1 distance never exceeds the symmetric difference, so that no link is
lost; what passes is verified as well. No pair is left out, sampled or capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import drop, session, text_rows, written
from leadline.llm.components import components
from leadline.llm.words import grams, mix, words_of

BUCKET_BITS, BLOCK_BITS = 21, 14
#: The largest l, and what verifying a candidate costs in postings read.
MOST_MATCHES, VERIFY_COST = 4, 8
#: Longest posting list that is joined as pairs, members of a block of a longer one and its visitors, places of a histogram.
SMALL, BLOCK, PLACES = 32, 2048, 128


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text of a string column."""
    for lo, hi, h, offsets in words_of(column):
        g, to = grams(h, offsets, words)
        for d in range(hi - lo):
            yield np.unique(g[to[d] : to[d + 1]])


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _first_pass(rows: DataFrame, words: int) -> DataFrame:
    """One row for each text (its set's size and digest) and, from each task, its counts of shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, n_waiting = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        for batch in batches:
            n, s1, s2 = [], [], []
            for s in sets_of(batch.column("text"), words):
                n.append(len(s))
                s1.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                s2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(s) else 0)
                waiting.append(_buckets(s))
                n_waiting += len(s)
            if n_waiting > 1 << 21:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                waiting, n_waiting = [], 0
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], NAMES)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        if counts.any():
            blocks = counts.astype(np.int64).reshape(-1, 1 << BLOCK_BITS)
            k = len(blocks)
            packed = [zlib.compress(b.tobytes(), 1) for b in blocks]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.array(range(k), pa.int32()), pa.array([task] * k, pa.int32()), pa.array(packed, pa.binary())], NAMES)

    NAMES = ["doc_id", "n", "s1", "s2", "block", "task", "counts"]
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, block int, task int, counts binary")


def _frequencies(first: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by bucket, on a logarithmic scale: 2**21 16-bit numbers."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.int64)
        return pdf.head(1).assign(counts=[zlib.compress(total.tobytes(), 1)])

    c = first.filter("block is not null").select("block", F.expr("task div 64").alias("task"), "counts")
    c = c.groupBy("block", "task").applyInPandas(add, "block int, task int, counts binary").select("block", F.expr("task div 64").alias("task"), "counts")
    c = c.groupBy("block", "task").applyInPandas(add, "block int, task int, counts binary").select("block", F.lit(0).alias("task"), "counts")
    counts = np.zeros((1 << BUCKET_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int64)
    for r in c.groupBy("block").applyInPandas(add, "block int, task int, counts binary").toLocalIterator():
        counts[r.block] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.floor(np.log2(counts.ravel() + 1.0) * 1024).astype(np.uint16)


def overlap_needed(percent: int, a: int, b: int) -> int:
    """The least shared shingles with which sets of sizes a and b reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def prefixes(s: np.ndarray, scale: np.ndarray, percent: int, base: float) -> tuple[np.ndarray, int, int, int]:
    """(shingles of the longer prefix, length of the probe prefix, of the index prefix, l) of one set."""
    n = len(s)
    level = scale[_buckets(s)]
    order = np.argsort((level.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")
    probe_o, index_o = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    index = min(n, n - index_o + MOST_MATCHES)
    most = min(MOST_MATCHES, probe_o)
    longest = n - probe_o + most
    postings = np.cumsum(np.maximum(np.exp2(level[order[:longest]] / 1024.0) - base, 1.0))
    l = min(range(1, most + 1), key=lambda k: postings[n - probe_o + k - 1] * (1 + VERIFY_COST / k))
    probe = n - probe_o + l
    return s[order[: max(probe, index)]], probe, index, l


def _prefix_rows(rows: DataFrame, words: int, percent: int, scale: np.ndarray) -> DataFrame:
    """doc_id, n, s1, l and the prefix's shingles, the length of its probe and index part."""
    shared = rows.sparkSession.sparkContext.broadcast(scale)
    base = float(np.exp2(np.median(scale) / 1024.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text"), words), strict=True):
                if len(s) and doc is not None:
                    tokens, probe, index, l = prefixes(s, shared.value, percent, base)
                    got.append((doc, len(s), int(mix(s).sum().view(np.int64)), l, probe, index, tokens.view(np.int64)))
            cols = [*zip(*got, strict=True)] if got else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n", "s1", "l", "probe", "index", "tokens"])

    return rows.mapInArrow(run, "doc_id long, n long, s1 long, l int, probe int, index int, tokens array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n, and the set as bytes, with its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*sets_of(batch.column("text"), words)]
            hist = [np.minimum(np.bincount((s & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES), 65535).astype(np.uint16).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(hist, pa.binary())], ["doc_id", "n", "members", "histogram"])

    return rows.mapInArrow(run, "doc_id long, n long, members binary, histogram binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that reach the similarity: the whole sets are intersected."""
    s = sets.select("doc_id", "members")
    with_sets = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= overlap_needed(percent, len(p), len(q)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_sets.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long").distinct()


def _across(percent: int):
    """For a block of one long posting list and some of its visitors: pairs of different components that can be similar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token = pdf["token"].iat[0]
        doc, n, comp, l, outside, visits = (pdf[c].to_numpy() for c in ("doc_id", "n", "component", "l", "outside", "visits"))
        hist = np.stack([np.frombuffer(h, np.uint16) for h in pdf["histogram"]]).astype(np.int32)
        probe, index = [frozenset(x) for x in pdf["probe_tokens"]], [frozenset(x) for x in pdf["index_tokens"]]
        home = np.flatnonzero(~visits)
        out = set()
        for x in np.flatnonzero(visits):
            # two members that both visit meet twice, and count where the lesser one is at home
            lesser = ~outside[home] | (n[home] < n[x]) | (n[home] == n[x]) & (doc[home] < doc[x])
            near = home[lesser & (comp[home] != comp[x]) & (100 * np.minimum(n[home], n[x]) >= percent * np.maximum(n[home], n[x]))]
            if len(near):
                apart = np.abs(hist[near] - hist[x]).sum(axis=1)
                near = near[apart * (100 + percent) <= (100 - percent) * (n[near] + n[x])]
            for y in near:
                a, b = (x, y) if (n[x], doc[x]) > (n[y], doc[y]) else (y, x)  # the larger one probes
                shared = probe[a] & index[b]
                if len(shared) >= l[a] and token == min(shared):
                    out.add((min(doc[x], doc[y]), max(doc[x], doc[y])))
        return pd.DataFrame([*out], columns=["a", "b"], dtype="int64")

    return run


def _met(here: DataFrame, percent: int) -> DataFrame | None:
    """Members of long posting lists that are in several components, dealt into blocks by size, and their visitors.

    A list's largest component stays at home; each other member visits the blocks of its band of sizes and of the
    two beside it, since sets that link differ by a band at most. Blocks hold at most about ``BLOCK`` of each kind.
    So a list makes as many rows as members, and more only by members outside * members / ``BLOCK``. None if there
    is no such list.
    """
    sizes = here.groupBy("token", "component").agg(F.count("*").alias("rows"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("rows", "component"))["component"].alias("largest"), F.sum("rows").alias("members"), F.max("rows").alias("rows"), F.count("*").alias("parts")).filter("parts > 1")
    lists = written(lists.select("token", "largest", F.ceil((F.col("members") - F.col("rows")) / BLOCK).cast("int").alias("groups")), "lists")
    if not lists.limit(1).count():
        return None
    width = float(np.log(100 / percent)) * (1 + 1e-9) or 1e-9
    rows = here.join(lists, "token").withColumns({"band": F.floor(F.log("n") / width), "outside": F.col("component") != F.col("largest")}).drop("largest")
    bands = rows.groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # at home in one block, once for each group of visitors; visiting all blocks of three bands, in one group
    rows = rows.withColumns({"to": F.when(F.col("outside"), F.array(*[F.struct((F.col("band") + k).alias("band"), F.lit(v).alias("visits")) for k, v in ((0, False), (-1, True), (0, True), (1, True))])).otherwise(F.array(F.struct("band", F.lit(False).alias("visits"))))})
    rows = rows.drop("band").withColumn("to", F.explode("to")).select("*", "to.band", "to.visits").drop("to").join(bands, ["token", "band"])
    own = F.when(F.col("visits"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))
    group = F.when(F.col("visits"), F.array(F.pmod(F.xxhash64(F.lit(1), "doc_id"), "groups").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("groups") - 1))
    return rows.withColumn("own", F.explode(own)).withColumn("group", F.explode(group)).select("token", "band", "own", "group", "visits", "outside", "doc_id", "n", "l", "component")


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts under Jaccard similarity of their word shingle sets.

    A-Z count as a-z, words are runs without space and 0x09-0x0D. A text with fewer words than a
    shingle is one shingle; a null, empty or blank text has none and is linked with nothing. Two
    documents link when 100 * shared >= percent * all their shingles. Returns one row for each input row:
    doc_id long, n_shingles long, component_id long (the smallest id that links reach).
    Rows that repeat an id are one vertex; a null id gets a null component and links nothing; an empty
    table gives an empty one; a very long text is taken whole, its set in one piece; other columns, whatever
    they are called, are not read. Ids must be integers.
    """
    session(docs)
    rows = text_rows(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(_first_pass(rows, words), "sets")
    texts = first.filter("block is null").select("doc_id", "n", "s1", "s2")
    known = texts.filter("n > 0 and doc_id is not null")
    # a table of its own: both sides of the join below are then plain exchanges, and a class of many copies can be split
    classes = written(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    scale = _frequencies(first)

    members = written(known.join(classes, ["n", "s1", "s2"]).select("doc_id", "n", "s1", "rep").distinct(), "copies")
    reps = members.select(F.col("rep").alias("doc_id"), "n", "s1").distinct()
    prefix = _prefix_rows(rows, words, percent, scale).dropDuplicates(["doc_id", "s1"]).join(reps, ["doc_id", "n", "s1"], "left_semi")
    postings = written(
        prefix.select("doc_id", "n", "l", F.size("tokens").alias("p"), "probe", "index", F.posexplode("tokens").alias("at", "token")).select("token", "doc_id", "n", "l", "p", (F.col("at") < F.col("probe")).alias("probe"), (F.col("at") < F.col("index")).alias("index")),
        "postings",
    )
    shared = postings.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1")
    every_posting, postings = postings, written(postings.join(shared, "token"), "shared")
    drop(every_posting)
    small, large = postings.filter(F.col("length") <= SMALL), postings.filter(F.col("length") > SMALL)

    # few postings: pairs, counted; what the probe shares in long lists counts as shared here
    long_probe = large.filter("probe").groupBy("doc_id").agg(F.count("*").alias("in_long"))
    a = small.filter("probe").select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("l").alias("la"))
    b = small.filter("index").select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("nb") * 100 >= F.col("na") * percent) & ((F.col("nb") < F.col("na")) | (F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    pairs = a.join(b, "token").filter(fits).groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("la").alias("la"))
    pairs = pairs.join(long_probe.withColumnRenamed("doc_id", "a"), "a", "left").filter(F.col("shared") + F.coalesce("in_long", F.lit(0)) >= F.col("la")).select("a", "b")

    # many: each to the list's most central member, the one with the least share of shingles of its own
    common = postings.groupBy("doc_id", "n").agg((F.count("*") / F.max("p")).alias("common"))
    ranked = large.join(common, ["doc_id", "n"]).select("token", "doc_id", "common")
    centre = ranked.groupBy("token").agg(F.max(F.struct("common", -F.col("doc_id"))).alias("c")).select("token", (-F.col("c.col2")).alias("b"))
    stars = large.join(centre, "token").filter("doc_id != b").select(F.col("doc_id").alias("a"), "b")
    candidates = written(pairs.unionByName(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    asked = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select("doc_id")).distinct()
    sets = written(_sets(rows.join(asked, "doc_id", "left_semi"), words), "members")
    # an id that is in two classes joins them
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a != b").select("doc_id", "b").join(members.select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", "b")
    links = written(_verified(candidates, sets, percent).unionByName(twice), "links")
    found = written(components(links), "components")

    # what differs in component is compared within long lists, block by block
    here = written(large.join(found, large.doc_id == found.id, "left").select("token", "doc_id", "n", "l", "probe", "index", F.coalesce("component", "doc_id").alias("component")).distinct(), "long")
    met = _met(here, percent)
    if met is None:
        return _by_document(texts, members, found)
    tokens = here.groupBy("doc_id").agg(F.collect_set(F.when(F.col("probe"), F.col("token"))).alias("probe_tokens"), F.collect_set(F.when(F.col("index"), F.col("token"))).alias("index_tokens"))
    met = met.join(tokens, "doc_id").join(sets.select("doc_id", F.col("n").alias("n"), "histogram").distinct(), ["doc_id", "n"])
    more = written(met.groupBy("token", "band", "own", "group").applyInPandas(_across(percent), "a long, b long").distinct(), "across")
    every = found
    if more.limit(1).count():
        late = written(_verified(more, sets, percent), "late")
        if late.limit(1).count():
            every = components(late.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    return _by_document(texts, members, every)


def _by_document(texts: DataFrame, members: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each text, with its class's component."""
    by_rep = members.select("doc_id", "rep").distinct().join(every, F.col("rep") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return texts.join(by_rep, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
