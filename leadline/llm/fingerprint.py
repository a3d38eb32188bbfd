"""Canonical exact digests of whole texts, with DataFrame functions only.

A text is brought to compatibility form (NFKC), folded case and single spaces; two 64-bit xxhash values
with different seeds are its wide digest. Texts with equal digests are then compared byte by byte; of
different ones in a bucket all but the first get a number after their digest, so equal fingerprints mean
equal canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.common import text_rows, written

#: Bits of the table that tells which texts can share a digest: 2 MB, whatever the input.
SHARED_BITS = 24
#: Documents in a range of ids on average, and the most ranges there are, on average too.
RANGE_ROWS, MOST_RANGES = 512, 1 << 18


def _icu(kind: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The text in NFKC with folded case, each run of white space as one space and none at the ends.

    Spark takes the calls of the normaliser for ones that can't be repeated, so this goes into a column of its
    own and what is made from it refers to that column.
    """
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text)))
    form = F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(form, r"[\s\u001c-\u001f\u0085   -     　]+", " "))


def digest(canon: Column) -> Column:
    """The wide digest as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def mark(canon: Column) -> Column:
    return F.sha2(F.encode(canon, "UTF-8"), 256)


def named(rows: DataFrame) -> DataFrame:
    """The rows with text_hash (of the text as it is), digest and mark: SHA-256 of the canonical text, for which it stands in joins."""
    return rows.withColumn("_canon", canonical(F.col("text"))).withColumns({"text_hash": F.xxhash64("text"), "digest": digest(F.col("_canon")), "mark": mark(F.col("_canon"))}).drop("_canon")


def _place(h: Column) -> Column:
    return F.xxhash64(h).bitwiseAND(F.lit((1 << SHARED_BITS) - 1))


def collisions(rows: DataFrame, known: DataFrame) -> DataFrame | None:
    """(digest, mark, number) of texts whose digest is that of a different text with a smaller id; None if there are none, as a rule.

    ``known`` has doc_id, text_hash and digest of each of the rows. Only digests that occur twice matter. A bit
    table of fixed size, made of those rows' text hashes, keeps other texts from being read further; in the
    buckets left, the least and the greatest canonical text are the same bytes unless there is a collision.
    Each task reduces a bucket to these two before anything is shuffled, so many copies are no large group.
    """
    texts = known.groupBy("digest", "text_hash").agg(F.count("*").alias("n"))
    twice = texts.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest")
    hashes = texts.join(twice, "digest").select("text_hash").distinct()
    bits = hashes.groupBy(F.bitmap_bucket_number(_place(F.col("text_hash"))).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_place(F.col("text_hash")))).alias("bits"))
    bit = F.bitmap_bit_position(_place(F.col("text_hash")))
    byte = F.ascii(F.decode(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("part", F.bitmap_bucket_number(_place(F.col("text_hash"))))
    shared = hashed.join(F.broadcast(bits), "part").filter(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1).select("doc_id", canonical(F.col("text")).alias("canon"))
    shared = shared.withColumn("digest", digest(F.col("canon")))
    ends = shared.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).filter("least != most")
    odd = written(ends.select("digest"), "collisions")
    if not odd.limit(1).count():
        return None
    # the least id may repeat with different texts, of which the least counts
    texts = shared.join(odd, "digest").groupBy("digest", "canon").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("first", "canon")))
    return ranked.filter("rank > 1").select("digest", mark(F.col("canon")).alias("mark"), F.row_number().over(Window.partitionBy("digest").orderBy("canon")).alias("number"))


def _with_numbers(known: DataFrame, odd: DataFrame | None) -> DataFrame:
    """The rows of ``known`` with fingerprint: the digest, and after it the number of a text that isn't its bucket's first."""
    if odd is None:
        return known.withColumn("fingerprint", F.col("digest"))
    return known.join(odd, ["digest", "mark"], "left").withColumn("fingerprint", F.concat("digest", F.coalesce(F.concat(F.lit("-"), F.col("number").cast("string")), F.lit("")))).drop("number")


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact groups of whole texts: doc_id, fingerprint string, group_id (the least id), group_size long.

    One row for each input row; ids may be of any type that has an order. Null and empty texts are one group,
    very long texts are taken whole, null ids stay null and don't become a group's id unless it has no other;
    repeated rows count each; an empty table gives an empty one; other columns, whatever they are called, are
    not read.
    """
    rows = text_rows(docs, id_col, text_col)
    known = written(named(rows).drop("text"), "digests")
    known = _with_numbers(known, collisions(rows, known)).select("doc_id", "fingerprint")
    groups = known.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return known.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size")


def _ranges(keys: DataFrame) -> DataFrame:
    """One row with the sorted edges of ranges of (doc_id, text_hash)."""
    apart = max(RANGE_ROWS, -(-keys.count() // MOST_RANGES))
    key = F.struct("doc_id", "text_hash").alias("key")
    chosen = keys.filter(F.pmod(F.xxhash64(F.lit("edge"), "doc_id", "text_hash"), F.lit(apart)) == 0).select(key).distinct()
    return written(chosen.agg(F.array_sort(F.collect_list("key")).alias("edges")), "edges")


def _in_ranges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows with ``range``, the number of edges up to them, by halving: the edges are one value that goes to every task."""
    halves = F.array(*[F.lit(1 << k) for k in range(MOST_RANGES.bit_length() + 1, -1, -1)])
    key = F.struct("doc_id", "text_hash")
    at = F.aggregate(halves, F.lit(0), lambda i, half: F.when(F.get("edges", i + half - 1) <= key, i + half).otherwise(i))
    return rows.withColumn("edges", edges.scalar()).withColumn("range", at).drop("edges")


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows of (doc_id, text, text_hash and others) with next_text, the text of the next document by ascending id, and next_ of each carried column.

    The first follows the last. Rows of one id follow each other by hash of the text; null ids come before all
    and never follow the last. Rows go to ranges of (id, hash of the text), about ``RANGE_ROWS`` rows each, whose
    edges are ids taken evenly from all; each range's first row goes to the range before it too, so that one
    shuffle of the texts is enough, whatever the ids are. Rows alike in id and text count once in this, and
    come out as often as they went in: each but the last of them is followed by the same text.
    """
    keys = written(rows.select("doc_id", "text_hash"), "keys")
    if repeats := bool(keys.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()):
        rest = [c for c in rows.columns if c not in ("doc_id", "text", "text_hash")]
        rows = rows.groupBy("doc_id", "text", "text_hash").agg(F.count("*").alias("_copies"), *[F.min(c).alias(c) for c in rest])
    edges = _ranges(keys)
    firsts = _in_ranges(keys, edges).groupBy("range").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    head = keys.filter("doc_id is not null").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    # a row for each range, and one for where the last range goes on
    order = Window.orderBy("range")
    before = firsts.withColumn("to", F.lag("range").over(order)).filter("to is not null").select("first.doc_id", "first.text_hash", "to")
    after = firsts.agg(F.max("range").alias("to")).withColumn("_one", F.lit(1)).join(head.withColumn("_one", F.lit(1)), "_one").filter("head is not null").select("head.doc_id", "head.text_hash", "to")
    copies = before.unionByName(after).groupBy("doc_id", "text_hash").agg(F.collect_list("to").alias("to"))
    same = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    dealt = _in_ranges(rows, edges).alias("r").join(F.broadcast(copies).alias("c"), same("doc_id") & same("text_hash"), "left").select("r.*", "c.to")
    places = F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))), F.coalesce(F.transform("to", lambda t: F.struct(t.alias("range"), F.lit(True).alias("copy"))), F.array()))
    dealt = dealt.withColumn("_at", F.explode(places)).drop("range", "to").select("*", "_at.range", "_at.copy").drop("_at")
    w = Window.partitionBy("range").orderBy("copy", "doc_id", "text_hash", "text")
    names = ("text", *carried)
    out = dealt.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(w), F.col(c)) for c in names}).filter("not copy").drop("range", "copy")
    if not repeats:
        return out
    turns = F.array(F.struct(F.lit(1).cast("long").alias("times"), *[F.col(f"next_{c}").alias(c) for c in names]), F.struct((F.col("_copies") - 1).alias("times"), *[F.col(c).alias(c) for c in names]))
    out = out.withColumn("_turn", F.explode(turns)).withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("_turn.times").cast("int"))))
    return out.withColumns({f"next_{c}": F.col(f"_turn.{c}") for c in names}).drop("_turn", "_time", "_copies")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited form, and their likeness: 1 for equal ones, else 0.

    The edited form has the last floor(n / 2) code points replaced by the first as many (or all) of the next
    document. Returns one row for each input row: doc_id, n_chars long, edited_sha256, fingerprint,
    edited_fingerprint string, near_edited, near_next double. Equal digests count as equal only if the
    canonical texts are equal, byte by byte. Ids may be of any type that has an order. Null and empty texts are
    alike, very long texts are taken whole, an empty table gives an empty one; see ``with_next`` for repeated
    and null ids; other columns, whatever they are called, are not read.
    """
    rows = text_rows(docs, id_col, text_col)
    pairs = with_next(named(rows), "digest").withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, n - half)"), F.expr("left(next_text, half)")))
    pairs = pairs.withColumn("canon_edited", canonical(F.col("edited"))).withColumn("edited_digest", digest(F.col("canon_edited")))
    # what has an equal digest is normalised again, for its bytes
    own = canonical(F.col("text"))
    same_edited = F.when(F.col("edited") == F.col("text"), True).when(F.col("edited_digest") == F.col("digest"), F.col("canon_edited") == own).otherwise(False)
    same_next = F.when(F.col("next_text") == F.col("text"), True).when(F.col("next_digest") == F.col("digest"), canonical(F.col("next_text")) == own).otherwise(False)
    narrow = pairs.select("doc_id", "text_hash", "n", "digest", "mark", "edited_digest", same_edited.alias("same_edited"), same_next.alias("same_next"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    known = written(narrow, "likeness")
    return _with_numbers(known, collisions(rows, known)).select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        F.when(F.col("same_edited"), F.col("fingerprint")).when(F.col("edited_digest") == F.col("digest"), F.concat("edited_digest", F.lit("-edited"))).otherwise(F.col("edited_digest")).alias("edited_fingerprint"),
        F.col("same_edited").cast("double").alias("near_edited"),
        F.col("same_next").cast("double").alias("near_next"),
    )
