"""Conversations from messages that quote each other.

Each message is cut into its own lines and quoted lines with their level (the number of marks before
them); lines that introduce a quotation are left out. Passages, quoted and own, are lines and blocks of
lines brought to lower case and single spaces, and hashed. A quoted passage belongs to the latest earlier
message of the conversation with that passage of its own: one ordered pass over each passage's
messages, so a passage that thousands of messages share costs a sort, not pairs. The message replied to is that of
the shallowest level with a match, by most characters. Roots and depths come from pointer doubling.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.common import session, written

MARKS = re.compile(r"(?:[ \t]?>)+[ \t]?")
#: The same where lines are stuffed: marks one after another, then a blank; a blank alone is no mark, and goes.
STUFFED = re.compile(r">*[ ]?")
INTRODUCES = re.compile(r"\s*(?:on\b.{0,200}\bwrote|.{0,100}\b(?:wrote|writes|schrieb|a écrit|escribió))\s*:\s*", re.IGNORECASE)
#: Turns ranked together when places in a conversation are given.
STEP = 4096


def parse(text: str, stuffed: bool = False) -> tuple[str, list[str], list[tuple[int, str, int]]]:
    """(own text, digests of own passages, quoted passages as (level, digest, characters)) of a message.

    In a stuffed message marks stand first in their line, and one blank after them, or first in a line of the author's
    own, was put there by ``as_mail`` and goes: lines that begin with a mark or a blank of their own stay as they are,
    and so does white space about the own text, which is taken away from other messages.
    """
    lines = []
    for line in text.split("\n"):
        m = (STUFFED if stuffed else MARKS).match(line)
        lines.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    own, kept = [], []
    for k, (level, line) in enumerate(lines):
        if level == 0 and INTRODUCES.fullmatch(line) and any(v for v, _ in lines[k + 1 : k + 3]):
            continue
        kept.append((level, line))
        if level == 0:
            own.append(line)
    blocks: list[tuple[int, list[str]]] = []
    for level, line in kept:
        if blocks and blocks[-1][0] == level and line.strip():
            blocks[-1][1].append(line)
        elif line.strip():
            blocks.append((level, [line]))
        else:
            blocks.append((level, []))
    digests, quoted = [], []
    for level, block in blocks:
        passages = {_normal(x) for x in block} | ({_normal(" ".join(block))} if block else set())
        for p in sorted(passages - {""}):
            d = hashlib.md5(p.encode()).hexdigest()
            if level:
                quoted.append((level, d, len(p)))
            else:
                digests.append(d)
    text = "\n".join(own)
    return text if stuffed else text.strip(), sorted(set(digests)), quoted


def _normal(passage: str) -> str:
    return " ".join(passage.lower().split())


def _parsed(rows: DataFrame, stuffed: bool) -> DataFrame:
    kind = {c: t for c, t in rows.dtypes}
    quoted = pa.list_(pa.struct([("level", pa.int32()), ("digest", pa.string()), ("chars", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(v.as_py() or "", stuffed) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([[dict(zip(("level", "digest", "chars"), q, strict=True)) for q in g[2]] for g in got], quoted)],
                ["conv_id", "turn", "role", "text", "own", "quoted"],
            )

    return rows.mapInArrow(run, f"conv_id {kind['conv_id']}, turn long, role string, text string, own array<string>, quoted array<struct<level:int,digest:string,chars:long>>")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stuffed: bool = False) -> DataFrame:
    """Messages without quotations, linked to what they reply to, in reply order.

    Returns one row for each input row: conv_id, turn long, role, parent_turn long (null: starts a thread),
    root_turn long, depth long (0 for a root), position long (place in its thread, from 0, replies after what
    they answer), n_quoted, n_linked long (quoted passages, and those with an original), text string.
    With ``stuffed`` messages are as ``as_mail`` writes them (``parse``). Null and empty texts have no passages; a null conversation or turn links nothing and is its own root;
    rows that repeat (conv_id, turn) are one message for links and keep their rows; of equal candidates the
    latest turn counts; an empty table gives an empty one; very long texts are parsed whole, line by line; other
    columns, whatever they are called, are not read.
    """
    session(messages)
    rows = messages.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parsed = written(_parsed(rows, stuffed), "messages")
    known = parsed.filter("conv_id is not null and turn is not null")
    own = known.select("conv_id", "turn", F.explode("own").alias("digest")).distinct().select("conv_id", "digest", "turn", F.col("turn").alias("origin"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("chars"))
    quoted = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "q.digest", "turn", F.lit(None).cast("long").alias("origin"), "q.level", "q.chars")
    # quotes of a turn stand before its own passages, so they see earlier turns only
    before = Window.partitionBy("conv_id", "digest").orderBy("turn", F.col("origin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    traced = own.unionByName(quoted).withColumn("source", F.last("origin", ignorenulls=True).over(before)).filter("level is not null")
    counts = traced.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"))
    votes = traced.filter("source is not null").groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "source"))["source"].alias("parent_turn"))
    nodes = written(known.select("conv_id", "turn").distinct().join(parents, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left"), "nodes")
    # root and depth: a pointer goes to its pointer's pointer until it is at a root; only those that aren't there yet are joined
    at = written(nodes.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"), F.col("parent_turn").isNotNull().cast("long").alias("depth"), F.col("parent_turn").isNull().alias("done")), "pointers")
    while at.filter("not done").limit(1).count():
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = at.filter("not done").join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        at = written(at.filter("done").unionByName(moved), "pointers")
    at = at.drop("done")
    # places: ranks within steps of turns, after the threads' counts of earlier steps
    placed = at.withColumnRenamed("up", "root_turn").withColumn("step", F.floor(F.col("turn") / STEP))
    steps = placed.groupBy("conv_id", "root_turn", "step").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "root_turn").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("conv_id", "root_turn", "step").orderBy("turn")) - 1
    placed = placed.withColumn("rank", rank).join(steps, ["conv_id", "root_turn", "step"]).select("conv_id", "turn", "root_turn", "depth", (F.col("rank") + F.col("earlier")).cast("long").alias("position"))
    linked = nodes.join(placed, ["conv_id", "turn"])
    return parsed.select("conv_id", "turn", "role", "text").join(linked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text",
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """Each turn as a reply by mail: the turn before the last quoted twice, the last one once, then its own text.

    Marks stand first in a quoted line, before a blank; own lines that begin with a mark or a blank get a blank before
    them, which ``parse`` takes away again, so a stuffed message gives back its own text, whatever it is. A null text is an
    empty one. Of a text without a word nothing can be quoted, so a reply to it is taken for one to the turn before it.
    Turns of any length are taken whole, repeated ones quote each other, those with a null conversation are one conversation
    here and linked with nothing later; an empty table gives an empty one; other columns are not read.
    """
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def quoted(level: int):
        marks = ">" * level + " "
        before = F.lag("text", level).over(turns)
        return F.when(before.isNotNull(), F.concat(F.lit(marks), F.replace(before, F.lit("\n"), F.lit("\n" + marks))))

    intro = F.concat(F.lit("On turn "), (F.lag("turn").over(turns)).cast("string"), F.lit(", "), F.coalesce(F.lag("role").over(turns), F.lit("someone")), F.lit(" wrote:"))
    own = F.regexp_replace("text", "(?md)^(?=[> ])", " ")
    return rows.select("conv_id", "turn", "role", F.concat_ws("\n", intro, quoted(2), quoted(1), own).alias("text"))
