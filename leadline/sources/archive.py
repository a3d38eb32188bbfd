"""A folder of crowdsourced files laid out as the public archive: pages of its index, and CSV files read where the list of them is."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.sources.crowd import MOST_BYTES, REQUIRED, csv_path, parse

#: Columns of CSV files that are read; others are skipped.
COLUMNS = (*REQUIRED, "UNIQUE_ID", "FILE_UUID", "PLATFORM_NAME", "PROVIDER")
# What a page of the index holds.
PAGE = "error struct<message:string>, features array<struct<attributes:struct<NAME:string,ITEM_ID:string,PLATFORM:string,PROVIDER:string,INSTRUMENT:string,START_DATE:string,END_DATE:string>>>"
#: Rows of a file are handed on in batches of so many.
BATCH = 4096


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of index pages (JSON files), as ``discover`` takes them; ``ord`` is the page's number, from its name, and the place in it.

    A page that says an error stops the job; records without a name have none here, times that are no whole numbers are null.
    """
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path)
    number = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))
    said = F.when(F.col("error").isNull(), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("index: "), F.coalesce("error.message", F.lit("query failed")))).cast("array<struct<attributes:struct<NAME:string,ITEM_ID:string,PLATFORM:string,PROVIDER:string,INSTRUMENT:string,START_DATE:string,END_DATE:string>>>"))
    rows = pages.select(number.alias("page"), F.posexplode(said).alias("n", "f"))
    a = lambda n: F.col(f"f.attributes.{n}")
    ms = lambda n: a(n).try_cast("double").cast("long")
    return rows.select(
        (F.shiftleft("page", 20) + F.col("n")).alias("ord"), a("NAME").alias("name"), a("ITEM_ID").alias("item_id"), a("PLATFORM").alias("platform"), a("PROVIDER").alias("provider"), a("INSTRUMENT").alias("instrument"),
        ms("START_DATE").alias("start_ms"), ms("END_DATE").alias("end_ms"),
    )


def _rows(system: fs.FileSystem, path: str) -> list[pa.RecordBatch]:
    """All rows of a CSV file as text, by the names of its header; the four required ones must be there."""
    out: list[pa.RecordBatch] = []
    with system.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="") as text:
        lines = csv.reader(text)
        header = [n.strip().upper() for n in next(lines, [])]
        if missing := [n for n in REQUIRED if n not in header]:
            raise ValueError(f"the CSV lacks {', '.join(missing)}")
        places = [header.index(n) if n in header else None for n in COLUMNS]
        held: list[list[str | None]] = [[] for _ in COLUMNS]

        def put() -> None:
            out.append(pa.RecordBatch.from_arrays([pa.array(h, pa.string()) for h in held], list(COLUMNS)))
            for h in held:
                h.clear()

        for line in lines:
            if not line:
                continue
            for h, at in zip(held, places, strict=True):
                h.append(line[at] if at is not None and at < len(line) else None)
            if len(held[0]) == BATCH:
                put()
        put()
    return out


def read_files(files: DataFrame, base: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of the CSV files of an index (as ``discover`` gives it), with file_name and the file's own platform, provider and instrument.

    The list of files stays distributed, and each is read by the task that has its name, from any file system that Arrow knows
    under ``base``. Where a file isn't there its older name is tried. A file that is absent, larger than ``most_bytes`` (it isn't
    opened then), or broken gives one row with ``error`` and nothing else; others come whole, without it. A name that is no archive's is absent, an
    empty file lacks its header; columns that lines are too short for are null.
    """
    paths = files.select("name", "platform", "provider", "instrument", csv_path(F.col("name"), base).alias("path"), csv_path(F.col("name"), base, legacy=True).alias("legacy"))
    whose = ["file_name", "file_platform", "file_provider", "file_instrument"]
    shape = pa.schema([(n, pa.string()) for n in (*COLUMNS, *whose, "error")])

    def one(name: str, path: str | None, legacy: str | None) -> list[pa.RecordBatch]:
        for p in (path, legacy):
            if p is None:
                continue
            system, at = fs.FileSystem.from_uri(p)
            info = system.get_file_info(at)
            if info.type != fs.FileType.File:
                continue
            if info.size is not None and info.size > most_bytes:
                raise ValueError(f"{info.size} bytes, over {most_bytes}")
            return _rows(system, at)
        raise FileNotFoundError(f"no CSV of {name}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                own, error = [f["name"], f["platform"], f["provider"], f["instrument"]], None
                try:
                    got = one(f["name"], f["path"], f["legacy"])
                except (OSError, ValueError, csv.Error) as e:
                    got, error = [pa.RecordBatch.from_arrays([pa.nulls(1, pa.string())] * len(COLUMNS), list(COLUMNS))], str(e) or type(e).__name__
                for b in got:
                    same = [pa.array([v] * b.num_rows, pa.string()) for v in (*own, error)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *same], schema=shape)

    # by name, so that files spread over tasks however few rows their list has
    return paths.repartition("name").mapInArrow(read, ", ".join(f"{n} string" for n in shape.names))


def of_file(name: str) -> Column:
    """The file's own platform, provider or instrument, for ``parse``."""
    return F.coalesce(f"file_{name}", F.lit("Unknown"))


def take(archive, files: DataFrame, base: str, bbox: tuple[float, float, float, float], imported_at_ms: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Reads files of an index into an ``Archive``: whole ones take their place, those that can't be read keep what they had. Their rows of the manifest.

    Files are read once; what they hold is staged under the archive's path, where the next import replaces it.
    """
    spark, staged = files.sparkSession, f"{archive.path}/staged"
    read_files(files, base, most_bytes).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    failed = rows.filter("error is not null").select(F.col("file_name").alias("name"), "error")
    whole = files.join(failed.select("name"), "name", "left_anti")
    parsed = parse(rows.filter("error is null"), bbox, {n: of_file(n) for n in ("platform", "provider", "instrument")}, keep=("file_name",))
    archive.ingest(whole, parsed, imported_at_ms)
    archive.mark_failed(files.join(failed, "name"))
    return archive.manifest().join(files.select("name"), "name", "left_semi")
