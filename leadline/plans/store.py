"""Stored tables: deduplicated appends, keyed replacement, numbered commits, replacement of soundings."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.operators.surface import CELL, build_cells, classify, history_of


def new_rows(batch: DataFrame, stored: DataFrame | None, order: list[str], key: str = "fingerprint") -> DataFrame:
    """Rows of a batch whose key isn't stored, the first of each."""
    one = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
    return one if stored is None else one.join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of the same keys replaced."""
    return stored.join(changed.select(*keys), keys, "left_anti").unionByName(changed)


def affected_cells(*soundings: DataFrame) -> DataFrame:
    """Distinct cells and datums of soundings old and new."""
    frames = [s.select("cell_x", "cell_y", F.col("tide_datum").alias("datum")) for s in soundings]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def apply_batch(cells: DataFrame | None, soundings: DataFrame, batch: DataFrame, config: Config, updated_at_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, qc, history) after a batch joins the active soundings: only the batch's cells are built anew, from their state before.

    ``soundings`` has the batch in it. What comes out for the other cells is what went in.
    """
    keys = affected_cells(batch)
    rows = _of_cells(soundings, keys)
    before = None if cells is None else cells.join(keys, CELL, "left_semi")
    built = build_cells(rows, config, before, updated_at_ms)
    return built if cells is None else upsert(cells, built.select(*cells.columns), CELL), classify(rows, config, before), history_of(built)


def rebuild_cells(cells: DataFrame, soundings: DataFrame, keys: DataFrame, config: Config, updated_at_ms: int) -> tuple[DataFrame, DataFrame]:
    """(cells, qc) with the cells of the keys built anew from the active soundings alone, whatever they were before; emptied ones go."""
    rows = _of_cells(soundings, keys)
    built = build_cells(rows, config, updated_at_ms=updated_at_ms)
    return cells.join(keys, CELL, "left_anti").unionByName(built.select(*cells.columns)), classify(rows, config)


def _of_cells(soundings: DataFrame, keys: DataFrame) -> DataFrame:
    return soundings.join(keys.withColumnRenamed("datum", "tide_datum"), ["cell_x", "cell_y", "tide_datum"], "left_semi")


def check_replacements(stored: DataFrame, successors: DataFrame) -> None:
    """Every successor (replaces_id, tide_datum, observed_at_ms) must replace one known sounding of its datum and time, once."""
    s = successors.join(stored.select(F.col("id").alias("replaces_id"), F.col("tide_datum").alias("_datum"), F.col("observed_at_ms").alias("_at")), "replaces_id", "left")
    wrong = s.filter("_at is null or _datum != tide_datum or _at != observed_at_ms or position_method != 'history_geometry_v1'").limit(1).count()
    twice = successors.groupBy("replaces_id").count().filter("count > 1").limit(1).count()
    if wrong or twice:
        raise ValueError("a replacement doesn't fit what it replaces; nothing was changed")


def replace_from_history(stored: DataFrame, replacements: DataFrame, successors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(soundings, replacements, cells to build without their state before), all or nothing."""
    check_replacements(stored, successors)
    links = successors.select(F.col("replaces_id").alias("original_id"), F.col("id").alias("replacement_id"))
    old = stored.join(links.select(F.col("original_id").alias("id")), "id", "left_semi")
    return stored.unionByName(successors.select(*stored.columns)), replacements.unionByName(links), affected_cells(old, successors)


class Conflict(RuntimeError):
    """Another writer made the commit first."""


class Commits:
    """Numbered commits in a folder: each is a small JSON file that appears at once, under its number from 0 on, and never changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, seq: int):
        return self._new(f"{self.path}/v{seq:020}")

    def last(self) -> dict | None:
        """What the newest commit says, with its number as ``seq``. It is searched by doubling, then halving: nothing is listed."""
        there = lambda n: self._fs.exists(self._file(n))
        if not there(0):
            return None
        low, high = 0, 1
        while there(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return json.loads("".join(r.value for r in self.spark.read.text(self._file(low).toString()).collect())) | {"seq": low}

    def add(self, seq: int, content: dict) -> None:
        """Adds a commit; one of that number that is there already is a conflict."""
        draft, final = self._new(f"{self.path}/draft-{uuid.uuid4().hex}"), self._file(seq)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"commit {seq} is there already")


#: So many parts of one size are merged into one of the next.
FAN = 8
#: Parts that merges took the place of stay for so many commits, for those who read them.
KEEP = 64


class Parts:
    """Tables in a folder whose commits name the parts that they consist of; several writers may work on them.

    A part is a folder of one attempt, so writers never touch each other's. ``change`` reads the newest commit, has its
    caller write parts, and commits; where another writer was first, what was written goes and the caller is asked anew.
    Parts of one size are merged as they gather, so a table has a few for each power of ``FAN``, whatever its age.
    """

    #: How parts of a table become one; a table that isn't named keeps all its rows.
    MERGES: dict[str, Callable[[DataFrame], DataFrame]] = {}
    #: Tables whose parts are folders by a column, and that column.
    BY: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def head(self) -> dict:
        return self.commits.last() or {"seq": -1, "sources": {}, "tables": {}, "facts": {}, "retired": []}

    def _folder(self, name: str, part: str) -> str:
        return f"{self.path}/{name}/part={part}"

    def table(self, head: dict, name: str) -> DataFrame | None:
        """A table as of a commit."""
        return self.parts(name, [p for p, _ in head["tables"].get(name, [])])

    def parts(self, name: str, parts: list[str]) -> DataFrame | None:
        if not parts:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[self._folder(name, p) for p in parts]).drop("part")

    def write(self, rows: DataFrame, name: str, made: dict[str, list[str]]) -> str:
        """Writes a part of this attempt and notes it in ``made``."""
        part = f"p{uuid.uuid4().hex}"
        made.setdefault(name, []).append(part)
        # a folder's rows together in files, those of a large one split
        if by := self.BY.get(name):
            order = [by, *[c for c in ("cell_x", "cell_y") if c in rows.columns]]
            w = rows.hint("rebalance", by).sortWithinPartitions(*order).write.partitionBy(by)
        else:
            w = rows.write
        w.parquet(self._folder(name, part))
        return part

    def _delete(self, name: str, part: str) -> None:
        p = self.commits._new(self._folder(name, part))
        self.commits._fs.delete(p, True)

    def _empty(self, name: str, part: str) -> bool:
        """Whether a part of folders has none."""
        return name in self.BY and not any(f.isDirectory() for f in self.commits._fs.listStatus(self.commits._new(self._folder(name, part))))

    def change(self, source: str, number: int, work: Callable[[dict, dict[str, list[str]]], dict | None], tries: int = 20) -> bool:
        """Commits what ``work(head, made)`` writes as a source's change of that number, unless it, or a later one, is there.

        What it writes under names that begin with ``_`` is its own and goes at the end; what it gives back are facts for the
        commit to keep, such as the last number of a row.
        """
        for _ in range(tries):
            head, made = self.head(), {}
            if head["sources"].get(source, -1) >= number:
                return False
            seq = head["seq"] + 1
            try:
                facts = work(head, made) or {}
                tables, retired = self._merged(head, made)
                drop = [x for x in retired if x[0] <= seq - KEEP]
                self.commits.add(seq, {"sources": head["sources"] | {source: number}, "tables": tables, "facts": head["facts"] | facts, "retired": [x for x in retired if x[0] > seq - KEEP]})
            except BaseException as e:
                for name, parts in made.items():
                    for p in parts:
                        self._delete(name, p)
                if isinstance(e, Conflict):
                    continue
                raise
            for name, part in [(n, p) for _, n, p in drop] + [(n, p) for n, parts in made.items() if n.startswith("_") for p in parts]:
                self._delete(name, part)
            return True
        raise Conflict(f"{source}: other writers were first {tries} times")

    def _merged(self, head: dict, made: dict[str, list[str]]) -> tuple[dict, list]:
        """(parts of all tables, parts retired) with those of this attempt, merged where enough of one size have gathered."""
        tables = {n: list(map(list, p)) for n, p in head["tables"].items()}
        retired, seq = list(head["retired"]), head["seq"] + 1
        for name in [n for n in made if not n.startswith("_")]:
            rows = tables.setdefault(name, [])
            rows += [[p, 0] for p in made[name] if not self._empty(name, p)]
            while len(rows) >= FAN and len({size for _, size in rows[-FAN:]}) == 1:
                old, size = [p for p, _ in rows[-FAN:]], rows[-1][1]
                every = self.parts(name, old)
                part = self.write(self.MERGES.get(name, lambda rows: rows)(every), name, made)
                retired += [[seq, name, p] for p in old]
                rows[-FAN:] = [] if self._empty(name, part) else [[part, size + 1]]
        return tables, retired


def rekey(soundings: DataFrame, cell_m: float) -> DataFrame:
    """Soundings under another grid; cells built under the old one must be dropped."""
    from leadline.functions.geo import hex_cell, mercator_x, mercator_y

    x, y = hex_cell(mercator_x(F.col("lon_e7") / 1e7), mercator_y(F.col("lat_e7") / 1e7), cell_m)
    return soundings.withColumns({"cell_x": x, "cell_y": y})
