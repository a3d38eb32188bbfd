"""Cells kept up to date from a stream of soundings: each micro-batch is deduplicated, appended, and its cells are built anew.

Beside soundings and cells the surface keeps what cells need of each pass, as rows that add up, so a batch reads
the passes of the cells that it touches and no old sounding. All tables lie in parts by attempt and, within
them, by area, a square of ``AREA_CELLS`` cells; a commit names the parts. A row says the number of the commit it
came with, and of a cell, or of a pass's QC, the newest row counts. Several writers may work on a surface: who is second builds
its batch anew on what the first has left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadline.config import Config
from leadline.operators.surface import CELL, PASS, added, cells_of_passes, classified, history_of, pass_rows, pass_states
from leadline.plans.store import Parts, affected_cells, new_rows, replace_from_history

#: Cells along an area: some 20 km, so that the whole globe has about a million areas.
AREA_CELLS = 4096


def with_area(rows: DataFrame) -> DataFrame:
    at = [F.floor(F.col(n) / AREA_CELLS).cast("string") for n in ("cell_x", "cell_y")]
    return rows.withColumn("area", F.concat(at[0], F.lit("_"), at[1]))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest seq of each key."""
    rest = [c for c in rows.columns if c not in {*keys, "area"}]
    return rows.groupBy(*keys, "area").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "area", "r.*")


def valid_passes(rows: DataFrame) -> DataFrame:
    """Rows of passes since their cell was last built from its soundings, which a row without a pass says."""
    since = F.max(F.when(F.col("pass_id").isNull(), F.col("seq"))).over(Window.partitionBy(*CELL))
    return rows.withColumn("_since", since).filter((F.col("seq") >= F.coalesce("_since", F.lit(-1))) | F.col("pass_id").isNull()).drop("_since")


def merged_passes(rows: DataFrame) -> DataFrame:
    """Rows of passes as fewer ones: counts of one pass added, the newest mark of each cell kept."""
    kept = valid_passes(rows).filter("pass_id is not null")
    marks = newest(rows.filter("pass_id is null"), CELL).select(rows.columns)
    sums = added(kept).join(kept.groupBy(*PASS).agg(F.first("area").alias("area"), F.max("seq").alias("seq")), PASS)
    return sums.select(rows.columns).unionByName(marks)


class Box:
    """Bounds of some soundings in cells and time, for scans to skip what lies outside."""

    def __init__(self, rows: DataFrame):
        names = ("cell_x", "cell_y", "observed_at_ms")
        self.ends = rows.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()

    def of(self, *names: str) -> Column:
        out = F.lit(True)
        for n in names:
            lo, hi = self.ends[f"min_{n}"], self.ends[f"max_{n}"]
            out = out & (F.col(n).between(lo, hi) if lo is not None else F.lit(False))
        return out


class Surface(Parts):
    """Soundings, passes, cells, QC and change history in a folder. A batch that comes again changes nothing."""

    BY = dict.fromkeys(("soundings", "replaced", "passes", "cells", "states"), "area")
    MERGES = {"passes": merged_passes, "cells": lambda rows: newest(rows, CELL), "states": lambda rows: newest(rows, PASS)}

    def __init__(self, spark: SparkSession, path: str, config: Config):
        super().__init__(spark, path)
        self.config = config

    def soundings(self) -> DataFrame | None:
        """All soundings, superseded ones too."""
        return self.table(self.head(), "soundings")

    def active(self) -> DataFrame | None:
        return self._active(self.head())

    def _active(self, head: dict, made: dict[str, list[str]] | None = None) -> DataFrame | None:
        """Active soundings as of a commit, with an attempt's own parts."""
        soundings, links = (self.parts(n, [p for p, _ in head["tables"].get(n, [])] + (made or {}).get(n, [])) for n in ("soundings", "replaced"))
        return soundings if links is None or soundings is None else soundings.join(links.select(F.col("original_id").alias("id"), "area"), ["id", "area"], "left_anti")

    def history(self) -> DataFrame | None:
        return self.table(self.head(), "history")

    def cells(self) -> DataFrame | None:
        rows = self.table(self.head(), "cells")
        return None if rows is None else newest(rows, CELL).filter("not is_gone").drop("area", "seq", "is_gone")

    def qc(self) -> DataFrame | None:
        """The latest QC of each active sounding, which it shares with its pass."""
        head = self.head()
        states = self.table(head, "states")
        return None if states is None else classified(self._active(head), newest(states, PASS).select(*PASS, "is_active"))

    def apply(self, batch: DataFrame, batch_id: int, updated_at_ms: int, source: str = "batch") -> None:
        """Takes a source's batch of soundings with fingerprints, once: batches of a source come with growing numbers.

        Equal fingerprints are of one place and time, so only the areas and the box of the batch are searched for them.
        """

        def work(head: dict, made: dict[str, list[str]]) -> None:
            given = with_area(batch)
            box = Box(given)
            stored = self._near(self.table(head, "soundings"), given)
            near = None if stored is None else stored.filter(box.of("cell_x", "cell_y", "observed_at_ms"))
            part = self.write(new_rows(given, near, ["observed_at_ms", "id"]), "soundings", made)
            if self._empty("soundings", part):
                return
            seq, new = F.lit(head["seq"] + 1), self.parts("soundings", [part])
            self.write(with_area(pass_rows(new, self.config)).withColumn("seq", seq), "passes", made)
            # from what was written: a batch's own rows are read once
            own = self.parts("passes", made["passes"])
            keys = own.select(*CELL).distinct()
            every = self.parts("passes", [p for p, _ in head["tables"].get("passes", [])] + made["passes"])
            of_keys = self._near(every, own).filter(box.of("cell_x", "cell_y")).join(keys, CELL, "left_semi")
            passes = added(valid_passes(of_keys).filter("pass_id is not null"))
            cells = self.table(head, "cells")
            before = None if cells is None else newest(self._near(cells, own).filter(box.of("cell_x", "cell_y")).join(keys, CELL, "left_semi"), CELL).filter("not is_gone")
            self._built(passes, keys, before, updated_at_ms, seq, made)

        self.change(source, batch_id, work)

    def _built(self, passes: DataFrame, keys: DataFrame, before: DataFrame | None, updated_at_ms: int, seq: Column, made: dict[str, list[str]]) -> None:
        """Writes the cells of the keys, from all their passes; those that have none are gone."""
        self.write(passes, "_passes", made)
        rows = self.parts("_passes", made["_passes"])
        built = cells_of_passes(rows, self.config, before, updated_at_ms)
        cells = keys.select(*CELL).distinct().join(built, CELL, "left").withColumn("is_gone", F.col("change_state").isNull())
        self.write(with_area(cells).withColumn("seq", seq), "cells", made)
        self.write(with_area(pass_states(rows, self.config, before)).withColumn("seq", seq), "states", made)
        self.write(history_of(self.parts("cells", made["cells"])), "history", made)

    def has(self, source: str, number: int = 0) -> bool:
        """Whether a source, or a job, has a commit of that number or a later one."""
        return self.head()["sources"].get(source, -1) >= number

    def replace(self, successors: DataFrame, name: str, updated_at_ms: int, number: int = 0) -> None:
        """Soundings rebuilt from history take their originals' places, all or none; the cells of both are built without their state before.

        ``name`` and ``number`` stand for the job and its step: one that comes again changes nothing.
        """

        def work(head: dict, made: dict[str, list[str]]) -> None:
            # what a rebuild gives is dear, and is read several times
            self.write(with_area(successors), "_successors", made)
            given = self.parts("_successors", made["_successors"])
            stored = self._active(head)
            if stored is None or given.isEmpty():
                return
            old = stored.join(given.select(F.col("replaces_id").alias("id")), "id", "left_semi")
            _, links, keys = replace_from_history(old, given.select(F.col("id").alias("original_id"), F.col("id").alias("replacement_id")).filter("false"), given)
            self.write(given.select(old.columns), "soundings", made)
            # a link lies in its original's area
            self.write(links.join(old.select(F.col("id").alias("original_id"), "area"), "original_id"), "replaced", made)
            seq = F.lit(head["seq"] + 1)
            rows = self._near(self._active(head, made), with_area(keys)).join(keys.withColumnRenamed("datum", "tide_datum"), ["cell_x", "cell_y", "tide_datum"], "left_semi")
            passes = pass_rows(rows, self.config)
            marks = keys.select(*CELL, *[F.lit(None).cast(t).alias(c) for c, t in passes.dtypes if c not in CELL])
            self.write(with_area(passes.unionByName(marks)).withColumn("seq", seq), "passes", made)
            own = self.parts("passes", made["passes"])
            self._built(own.filter("pass_id is not null").select(passes.columns), own.select(*CELL), None, updated_at_ms, seq, made)

        self.change(name, number, work)

    def _near(self, table: DataFrame | None, rows: DataFrame) -> DataFrame | None:
        """A table's rows in the areas of some rows. There are about a million areas at most, so they may go to every task and prune the scan."""
        return None if table is None else table.join(F.broadcast(rows.select("area").distinct()), "area", "left_semi")


def maintain(stream: DataFrame, surface: Surface, checkpoint: str, clock: Callable[[int], int] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Runs the surface over a stream of soundings; ``clock(batch_id)`` gives a batch's time of update in ms.

    The checkpoint's path names the stream: its batches are taken once each.
    """
    import time

    at = clock or (lambda _: int(time.time() * 1000))
    writer = stream.writeStream.foreachBatch(lambda df, n: surface.apply(df, n, at(n), checkpoint)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
