"""Crowdsourced soundings: index records, archive paths, CSV files, replacement by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.plans.store import Commits

ARCHIVE_NAME = r"(?i)^\d{8}.*\.tar\.gz$"
DEEPEST_M = 12_000
REQUIRED = ("LON", "LAT", "DEPTH", "TIME")


def discover(index: DataFrame, most: int | None = None) -> DataFrame:
    """Files of an index (ord, name, item_id, platform, provider, instrument, start_ms, end_ms): the first record of each archive name."""
    w = Window.partitionBy("name").orderBy("ord")
    kept = index.filter(F.col("name").rlike(ARCHIVE_NAME)).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    unknown = {n: F.coalesce(n, F.lit("Unknown")) for n in ("platform", "provider", "instrument")}
    out = kept.drop("_r").withColumns(unknown | {"item_id": F.coalesce("item_id", F.lit(""))})
    return out if most is None else out.orderBy("ord").limit(most)


def csv_path(name: Column, base: str = "", legacy: bool = False) -> Column:
    """Where an archive's CSV lies: base/csb/csv/YYYY/MM/DD/name; null for other names. Old submissions have another ending."""
    ending = "_pointData.csv" if legacy else ".csv"
    part = lambda a, n: F.substring(name, a, n)
    file = F.concat(F.regexp_replace(name, r"(?i)\.tar\.gz$", ""), F.lit(ending))
    return F.when(name.rlike(ARCHIVE_NAME), F.concat_ws("/", F.lit(f"{base}/csb/csv"), part(1, 4), part(5, 2), part(7, 2), file))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files as text, names of columns trimmed and in capitals; the four required ones must be there."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*[n.strip().upper() for n in df.columns])
    if missing := [n for n in REQUIRED if n not in df.columns]:
        raise ValueError(f"the CSV lacks {', '.join(missing)}")
    return df


def number(text: Column) -> Column:
    """Text as a number: blank is 0, null and what is no number NaN."""
    return F.when(text.isNull(), F.lit(float("nan"))).when(F.trim(text) == "", F.lit(0.0)).otherwise(F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan"))))


def parse(rows: DataFrame, bbox: tuple[float, float, float, float], metadata: dict[str, str | Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the box (west, south, east, north), with is_valid. Rows outside it, or without a readable place, are gone.

    Valid: a readable time and a depth over 0 and up to 12,000 m. Blank platform and provider fall back to the file's,
    texts or columns of the rows. Columns to keep go along.
    """
    cols = set(rows.columns)
    text = lambda n: F.col(n).cast("string") if n in cols else F.lit(None).cast("string")
    lon, lat, depth = number(text("LON")), number(text("LAT")), number(text("DEPTH"))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    inside = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3])
    at = F.unix_millis(F.try_to_timestamp(text("TIME")))
    out = rows.filter(inside).select(
        F.coalesce(text("UNIQUE_ID"), F.lit("")).alias("unique_id"), F.coalesce(text("FILE_UUID"), F.lit("")).alias("file_uuid"),
        lon.alias("longitude"), lat.alias("latitude"), depth.alias("depth_m"), at.alias("observed_at_ms"),
        fallback(text("PLATFORM_NAME"), F.lit(metadata.get("platform", "Unknown"))).alias("platform"),
        fallback(text("PROVIDER"), F.lit(metadata.get("provider", "Unknown"))).alias("provider"),
        F.lit(metadata.get("instrument", "Unknown")).alias("instrument"), *keep,
    )
    return out.withColumn("is_valid", finite(F.col("longitude")) & finite(F.col("latitude")) & finite(F.col("depth_m")) & (F.col("depth_m") > 0) & (F.col("depth_m") <= DEEPEST_M) & F.col("observed_at_ms").isNotNull())


def fallback(text: Column, other: Column) -> Column:
    """The text unless it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


POINT = T.StructType([T.StructField(n, t) for n, t in (("unique_id", T.StringType()), ("file_uuid", T.StringType()), ("longitude", T.DoubleType()), ("latitude", T.DoubleType()), ("depth_m", T.DoubleType()), ("observed_at_ms", T.LongType()), ("platform", T.StringType()), ("provider", T.StringType()), ("instrument", T.StringType()), ("file_name", T.StringType()))])


def replace_file(points: DataFrame, path: str) -> None:
    """Writes a file's valid points (with file_name) in the place of what the table had of that file; repeats count once."""
    points.dropDuplicates(Archive.KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_name").parquet(path)


#: A file is read up to this size.
MOST_BYTES = 64 << 20


def small_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, is_small) of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length", (F.col("length") <= most_bytes).alias("is_small"))


class Archive:
    """Points by file and a manifest of files, in parts by number of the commit; points and manifest change together.

    A file that comes again takes the place of what it had; one that fails keeps it.
    """

    KEYS = ["file_name", "unique_id", "file_uuid", "observed_at_ms", "longitude", "latitude", "depth_m"]
    MANIFEST = "name string, item_id string, platform string, provider string, instrument string, status string, is_full boolean, imported_at_ms long, sounding_count long, duplicate_count long, invalid_count long, error string, part long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def manifest(self) -> DataFrame:
        head = self.commits.last()
        return self.spark.createDataFrame([], self.MANIFEST) if head is None else self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/seq={head['seq']}")

    def points(self) -> DataFrame | None:
        """The points of the files' newest imports."""
        head = self.commits.last()
        if head is None or not head["points"]:
            return None
        rows = self.spark.read.parquet(f"{self.path}/points").filter(F.col("seq") <= head["seq"])
        newest = self.manifest().select(F.col("name").alias("file_name"), F.col("part").alias("seq"))
        return rows.join(newest, ["file_name", "seq"], "left_semi").drop("seq")

    def ingest(self, files: DataFrame, rows: DataFrame, imported_at_ms: int) -> DataFrame:
        """Takes files (as ``discover`` gives them) with their parsed rows (``parse``, and file_name); gives their rows of the manifest."""
        seq = self._next()
        valid = rows.filter("is_valid").drop("is_valid")
        valid.dropDuplicates(self.KEYS).write.mode("overwrite").parquet(f"{self.path}/points/seq={seq}")
        kept = self.spark.read.parquet(f"{self.path}/points/seq={seq}").groupBy("file_name").agg(F.count("*").alias("kept"))
        counts = rows.groupBy("file_name").agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")).join(kept, "file_name", "left").withColumnRenamed("file_name", "name")
        zero = lambda n: F.coalesce(n, F.lit(0)).cast("long")
        done = files.join(counts, "name", "left").withColumns({"status": F.lit("complete"), "is_full": F.lit(False), "imported_at_ms": F.lit(imported_at_ms).cast("long"), "sounding_count": zero(F.col("kept")), "duplicate_count": zero(F.col("valid")) - zero(F.col("kept")), "invalid_count": zero(F.col("invalid")), "error": F.lit(None).cast("string"), "part": F.lit(seq).cast("long")})
        return self._put(seq, done, points=True)

    def mark_failed(self, files: DataFrame) -> DataFrame:
        """Files (with error) that couldn't be read: what they had before stays."""
        had = self.manifest().select("name", "is_full", "imported_at_ms", "sounding_count", "duplicate_count", "invalid_count", "part")
        failed = files.withColumn("error", F.substring("error", 1, 1000)).join(had, "name", "left").withColumns({"status": F.lit("failed"), "is_full": F.coalesce("is_full", F.lit(False))})
        return self._put(self._next(), failed)

    def mark_full(self, names: DataFrame) -> DataFrame:
        """Files (name) that were read whole, beyond the box asked for."""
        return self._put(self._next(), self.manifest().join(names.select("name"), "name", "left_semi").withColumn("is_full", F.lit(True)))

    def progress(self) -> DataFrame:
        """One row of counts over the manifest: files, complete, failed, soundings, invalid."""
        done = F.col("status") == "complete"
        total = lambda n: F.coalesce(F.sum(F.when(done, F.col(n))), F.lit(0)).cast("long")
        return self.manifest().agg(F.count("*").alias("files"), F.count_if(done).alias("complete_files"), F.count_if(~done).alias("failed_files"), total("sounding_count").alias("imported"), total("invalid_count").alias("invalid"))

    def _next(self) -> int:
        head = self.commits.last()
        return 0 if head is None else head["seq"] + 1

    def _put(self, seq: int, rows: DataFrame, points: bool = False) -> DataFrame:
        names = [c.split()[0] for c in self.MANIFEST.split(", ")]
        changed = rows.select(names)
        self.manifest().join(changed.select("name"), "name", "left_anti").unionByName(changed).write.mode("overwrite").parquet(f"{self.path}/manifest/seq={seq}")
        head = self.commits.last()
        self.commits.add(seq, {"points": points or bool(head and head["points"])})
        return self.manifest().join(rows.select("name"), "name", "left_semi")


def missing_files(index: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """Index records whose file the manifest (name, status, is_full) doesn't have as complete, or as full."""
    have = manifest.filter("status = 'complete'") if not full else manifest.filter("is_full")
    return index.join(have.select("name"), "name", "left_anti")
