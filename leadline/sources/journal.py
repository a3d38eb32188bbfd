"""The raw journal: evidence as received, corrected only when read, exported in batches that are acknowledged."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.operators.ranges import numbered
from leadline.plans.store import Parts

_POSITION = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("source", T.StringType())])
_TIDE = T.StructType([T.StructField("height_m", T.DoubleType()), T.StructField("sigma_m", T.DoubleType()), T.StructField("datum", T.StringType()), T.StructField("station_id", T.StringType()), T.StructField("station_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("method", T.StringType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("stale", T.BooleanType())])
_TURN = T.StructType([T.StructField("roll_rad", T.DoubleType()), T.StructField("pitch_rad", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("timestamp_ms", T.LongType())])
_HEADING = T.StructType([T.StructField("heading_rad", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("timestamp_ms", T.LongType())])
OBSERVATION = T.StructType([
    T.StructField("observed_at_ms", T.LongType()), T.StructField("received_at_ms", T.LongType()), T.StructField("timestamp_origin", T.StringType()),
    T.StructField("depth_m", T.DoubleType()), T.StructField("depth_reference", T.StringType()), T.StructField("depth_source", T.StringType()),
    T.StructField("position", _POSITION), T.StructField("tide", _TIDE), T.StructField("surface_offset_m", T.DoubleType()),
    T.StructField("installation", T.MapType(T.StringType(), T.StringType())), T.StructField("quality", T.ArrayType(T.StringType())),
    T.StructField("attitude", _TURN), T.StructField("heading", _HEADING),
])
CONSENT, DAY_MS = "CC0-1.0", 86_400_000
#: Acknowledged batches whose names are kept, so that a late second word of one is understood.
KEPT_NAMES = 100


def quality_flags(receipt_time: Column, observed_ms: Column, received_ms: Column, position_ms: Column, position_receipt: Column, depth_m: Column, low_m: float, high_m: float, skew_ms: int) -> Column:
    """What is wrong with an observation, as an array of names."""
    said = [
        F.when(receipt_time, F.lit("receipt-time-only")),
        F.when(observed_ms > received_ms + 1000, F.lit("future-observation-time")),
        F.when(position_ms.isNull(), F.lit("missing-position")).when(F.abs(position_ms - observed_ms) > skew_ms, F.lit("stale-position")),
        F.when(position_ms.isNotNull() & position_receipt, F.lit("position-receipt-time-only")),
        F.when((depth_m <= 0) | ~depth_m.between(low_m, high_m), F.lit("outside-instrument-range")),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def fingerprint(rows: DataFrame, evidence: list[str]) -> Column:
    """SHA-256 of the evidence as JSON; when it was received is no evidence."""
    return F.sha2(F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"}), 256)


def append(journal: DataFrame | None, rows: DataFrame, evidence: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch that the journal doesn't have, the first of each fingerprint, numbered on from its last id."""
    new = unseen(journal, rows.withColumn("fingerprint", fingerprint(rows, evidence)), order)
    return numbered(new, order, 0 if journal is None else journal.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])


def unseen(journal: DataFrame | None, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with fingerprints that the journal doesn't have, the first of each."""
    w = Window.partitionBy("fingerprint").orderBy(*order)
    new = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if journal is None:
        return new
    # only fingerprints that come again leave the journal's scan
    again = journal.select("fingerprint").join(new.select("fingerprint"), "fingerprint", "left_semi")
    return new.join(again, "fingerprint", "left_anti")


def read(journal: DataFrame, after_id: int = 0, limit: int = 1000) -> DataFrame:
    """The next observations by id, with corrected depth and datum where tide and quality allow it."""
    if after_id < 0 or not 1 <= limit <= 10_000:
        raise ValueError("invalid cursor or limit")
    return with_corrections(journal.filter(F.col("id") > after_id).orderBy("id").limit(limit))


def with_corrections(journal: DataFrame) -> DataFrame:
    """The observations with corrected depth and datum, null where tide or quality don't allow it, and whether the offsets are verified."""
    depth = corrected("depth_m", "surface_offset_m", "tide", "quality")
    return journal.withColumns({"corrected_m": depth, "corrected_datum": F.when(depth.isNotNull(), F.col("tide.datum")), "offsets_verified": F.coalesce(F.col("installation")["offsetsVerified"] == "true", F.lit(False))})


def corrected(depth: str, offset: str, tide: str, quality: str) -> Column:
    """Depth by the tide of its own time: only with a tide that wasn't stale and no flags."""
    return F.when(F.col(tide).isNotNull() & ~F.coalesce(F.col(f"{tide}.stale"), F.lit(False)) & (F.size(quality) == 0), F.col(depth) + F.col(offset) - F.col(f"{tide}.height_m"))


def status(journal: DataFrame) -> DataFrame:
    return journal.agg(F.count("*").alias("count"), F.min("observed_at_ms").alias("first_at_ms"), F.max("observed_at_ms").alias("last_at_ms"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def features(journal: DataFrame) -> DataFrame:
    """GeoJSON features (id, feature) of observations without flags that have a position."""
    t = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("id"),
        F.struct(F.lit("Point").alias("type"), F.array("position.longitude", "position.latitude").alias("coordinates")).alias("geometry"),
        F.struct(t(F.col("observed_at_ms")).alias("time"), F.col("depth_m").alias("depth"), F.col("depth_reference").alias("depthReference"), F.col("depth_source").alias("depthSource"), F.col("position.source").alias("positionSource"), t(F.col("position.timestamp_ms")).alias("positionTime"), F.col("installation"), F.col("surface_offset_m").alias("surfaceOffsetM")).alias("properties"),
    )
    return journal.filter((F.size("quality") == 0) & F.col("position").isNotNull()).select("id", F.to_json(feature).alias("feature"))


class Outbox:
    """Batches for export: a pending one is given again until it is acknowledged, and only then does the cursor move.

    State is a dict that the caller keeps: a few numbers, one pending batch of at most 10,000 features, and the names of the last
    that were acknowledged.
    """

    def __init__(self, journal: DataFrame, state: dict):
        self.journal, self.state = journal, state

    def consent(self, enabled: bool) -> None:
        self.state["consent"] = CONSENT if enabled else ""

    def sample(self, after_id: int = 0, limit: int = 1000) -> dict:
        page = read(self.journal, after_id, limit)
        ids = [r.id for r in page.select("id").collect()]
        rows = features(page).orderBy("id").collect()
        return {"type": "FeatureCollection", "properties": {"coordinateReferenceSystem": "EPSG:4326", "afterId": after_id, "throughId": ids[-1] if ids else after_id, "scannedCount": len(ids), "excludedCount": len(ids) - len(rows), "journalVersion": 1}, "features": [json.loads(r.feature) for r in rows]}

    def prepare(self, limit: int = 1000) -> tuple[str | None, dict]:
        self._consented()
        cursor = self.state.setdefault("cursor", 0)
        for b in self.state.setdefault("batches", {}).items():
            if b[1]["after"] == cursor and not b[1]["done"]:
                return b[0], b[1]["sample"]
        sample = self.sample(cursor, limit)
        if not sample["properties"]["scannedCount"]:
            return None, sample
        name = hashlib.sha256(json.dumps(sample).encode()).hexdigest()
        self.state["batches"][name] = {"after": cursor, "through": sample["properties"]["throughId"], "sample": sample, "done": False}
        return name, sample

    def acknowledge(self, name: str) -> None:
        self._consented()
        batch = self.state.setdefault("batches", {}).get(name)
        if batch is None:
            raise ValueError("unknown export batch")
        if not batch["done"]:
            if batch["after"] != self.state["cursor"]:
                raise ValueError("export cursor conflict")
            self.state["cursor"], batch["done"] = batch["through"], True
            del batch["sample"]
            done = [n for n, b in self.state["batches"].items() if b["done"]]
            for n in done[:-KEPT_NAMES]:
                del self.state["batches"][n]

    def _consented(self) -> None:
        if self.state.get("consent") != CONSENT:
            raise PermissionError("publication is off; it needs explicit consent")


class Journal(Parts):
    """A journal in a folder, in parts by day of observation; a batch that comes again is left out.

    The time of observation is part of the evidence, so equal rows are of one day: a batch is held against the days that it
    has, however old the journal is, and the commits know the last number.
    """

    BY = {"rows": "day"}
    EVIDENCE = ["context", "observed_at_ms", "timestamp_origin", "depth_m", "depth_reference", "depth_source", "position", "tide", "surface_offset_m", "installation", "attitude", "heading"]
    ORDER = ["observed_at_ms", "received_at_ms", "context", "depth_source", "depth_m"]

    def read(self) -> DataFrame | None:
        """All observations of commits so far."""
        rows = self.table(self.head(), "rows")
        return None if rows is None else rows.drop("day")

    def of_days(self, head: dict, rows: DataFrame) -> DataFrame | None:
        """The journal's rows of the days, and within them of the times, of some rows."""
        stored = self.table(head, "rows")
        first, last = rows.agg(F.min("observed_at_ms"), F.max("observed_at_ms")).first()
        if stored is None or first is None:
            return None
        near = stored.filter(F.col("day").between(first // DAY_MS, last // DAY_MS) & F.col("observed_at_ms").between(first, last))
        return near.join(F.broadcast(rows.select("day").distinct()), "day", "left_semi")

    def add(self, rows: DataFrame, batch_id: int, source: str = "batch") -> None:
        """Appends a source's batch, once: batches of a source come with growing numbers."""

        def work(head: dict, made: dict[str, list[str]]) -> dict:
            evidence = [c for c in self.EVIDENCE if c in rows.columns]
            given = rows.withColumn("fingerprint", fingerprint(rows, evidence)).withColumn("day", F.floor(F.col("observed_at_ms") / DAY_MS))
            # written before they are numbered, which goes over them several times
            self.write(unseen(self.of_days(head, given), given, self.ORDER), "_new", made)
            last = head["facts"].get("last_id", 0)
            self.write(numbered(self.parts("_new", made["_new"]), self.ORDER, last), "rows", made)
            added = None if self._empty("rows", made["rows"][-1]) else self.parts("rows", made["rows"])
            return {"last_id": last if added is None else added.agg(F.max("id")).first()[0]}

        self.skipped = not self.change(source, batch_id, work)


def open_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
