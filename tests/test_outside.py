"""What comes in and goes out: deltas, files, the journal, tiles, streams, questions."""

import json
import math
import struct
import time

import pytest
from pyspark.sql import functions as F

from leadline import api
from leadline import queries as q
from leadline.config import Config
from leadline.operators import listing, surface
from leadline.plans import mvt, rebuild, store, tiles
from leadline.sources import crowd, deltas, journal
from leadline.streaming import cells as stream_cells
from leadline.streaming import live

C = Config()
T0 = 1_767_225_600_000


def test_deltas_are_flattened(spark, tmp_path):
    messages = [
        {"context": "vessels.x", "updates": [{"timestamp": "2026-01-01T00:00:01.500Z", "$source": "gps", "values": [{"path": "p", "value": {"latitude": 1.5, "longitude": 2.5}}, {"path": "d", "value": 5.25}, {"path": "t", "value": 1, "state": {"timedOut": True}}]}, {"timestamp": "2026-01-01T00:00:02Z", "meta": []}]},
        {"updates": [{"source": {"label": "n2k", "src": "7"}, "values": [{"path": "d", "value": 6}]}, {"timestamp": "bad", "source": {"type": "NMEA0183"}, "values": [{"path": "p", "value": [2.5, 91.0]}]}]},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, messages)))
    flat = deltas.flatten(deltas.read(spark, str(tmp_path / "m.json")), F.lit(99).cast("long"))
    lat, lon = deltas.position(F.col("value"))
    got = sorted((r.context, r.path, r.source, r.at_ms, r.lat, r.lon) for r in flat.withColumns({"lat": lat, "lon": lon}).collect() if r.path == "p")
    assert got == [("vessels.self", "p", "NMEA0183", 99, None, None), ("vessels.x", "p", "gps", T0 + 1500, 1.5, 2.5)]
    assert sorted((r.source, float(r.value)) for r in flat.filter("path = 'd'").collect()) == [("gps", 5.25), ("n2k", 6.0)] and flat.count() == 4
    r = live.readings_of(flat, {"p": "position", "d": "depth"}, F.lit(5))
    assert sorted((x.path, x.value) for x in r.collect()) == [("depth", 5.25), ("depth", 6.0), ("position", None)]


def test_resampling(spark):
    rows = spark.createDataFrame([("d", 100, 1.0), ("d", 900, 3.0), ("d", 1100, 5.0)], "path string, at_ms long, value double")
    assert sorted((r.at_ms, r.value) for r in deltas.resample(rows, ["path"], 1000).collect()) == [(0, 1.0), (1000, 5.0)]
    assert sorted((r.at_ms, r.value) for r in deltas.resample(rows, ["path"], 1000, "average").collect()) == [(0, 2.0), (1000, 5.0)]


def test_means_have_nothing_of_the_order_of_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("a", 3, 0.3), ("b", 1, 0.3), ("b", 2, 0.2), ("b", 3, 0.1), ("b", 4, None), ("c", 1, None)], "path string, at_ms long, value double").coalesce(1)
    got = {r.path: r.value for r in deltas.resample(rows, ["path"], 1000, "mean").collect()}
    assert got == {"a": (0.1 + 0.2 + 0.3) / 3, "b": (0.1 + 0.2 + 0.3) / 3, "c": None}


CSV = '''UNIQUE_ID,FILE_UUID, lon ,LAT,Depth,TIME,PLATFORM_NAME,PROVIDER
V1,F1,-122.4,37.8,12.5,2024-05-01T00:00:00.000Z,"Boat, ""B""",
V1,F1,-122.4,37.8,-1000000000,2024-05-01T00:00:01.000Z,,P
V1,F1,-10,37.8,5,2024-05-01T00:00:02.000Z,,P
V1,F1,x,37.8,5,2024-05-01T00:00:02.000Z,,P
'''


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    rows = crowd.parse(crowd.read_csv(spark, str(tmp_path / "a.csv")), (-123, 37, -122, 38), {"platform": "Unknown", "provider": "given", "instrument": "echo"})
    got = rows.collect()
    assert len(got) == 2 and [r.is_valid for r in got] == [True, False]
    assert (got[0].platform, got[0].provider, got[0].instrument, got[0].depth_m, got[0].observed_at_ms) == ('Boat, "B"', "given", "echo", 12.5, 1714521600000) and got[1].platform == "Unknown"
    (tmp_path / "b.csv").write_text("LON,LAT,DEPTH\n1,2,3\n")
    with pytest.raises(ValueError, match="TIME"):
        crowd.read_csv(spark, str(tmp_path / "b.csv"))


def test_archive_paths(spark):
    df = spark.createDataFrame([("20240501_x.tar.gz",), ("20240501_Y.TAR.GZ",), ("x.tar.gz",)], "n string")
    got = [(r.a, r.b) for r in df.select(crowd.csv_path(F.col("n"), "http://h").alias("a"), crowd.csv_path(F.col("n"), legacy=True).alias("b")).collect()]
    assert got[0] == ("http://h/csb/csv/2024/05/01/20240501_x.csv", "/csb/csv/2024/05/01/20240501_x_pointData.csv") and got[1][0].endswith("20240501_Y.csv") and got[2] == (None, None)


def test_a_file_takes_its_own_place(spark, tmp_path):
    path = str(tmp_path / "points")
    point = lambda f, d: ("v", "u", -122.4, 37.8, d, T0, "p", "q", "i", f)
    write = lambda rows: crowd.replace_file(spark.createDataFrame(rows, crowd.POINT), path)
    write([point("a", 1.0), point("a", 1.0), point("a", 2.0)])
    write([point("b", 3.0)])
    write([point("a", 9.0)])
    assert sorted((r.file_name, r.depth_m) for r in spark.read.parquet(path).collect()) == [("a", 9.0), ("b", 3.0)]
    index = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    manifest = spark.createDataFrame([("a", "complete", False), ("b", "failed", False)], "name string, status string, is_full boolean")
    assert {r.name for r in crowd.missing_files(index, manifest).collect()} == {"b", "c"} and crowd.missing_files(index, manifest, full=True).count() == 3


def observations(spark):
    place, tide = (37.8, -122.4, T0, "gps"), lambda stale: (1.0, 0.2, "MLLW", "1", "S", "t", "predicted", T0, stale)
    rows = [
        (T0, T0 + 5, "instrument", 4.0, "belowKeel", "d", place, tide(False), 1.5, {"offsetsVerified": "true"}, []),
        (T0, T0 + 900, "instrument", 4.0, "belowKeel", "d", place, tide(False), 1.5, {"offsetsVerified": "true"}, []),
        (T0 + 1, T0 + 5, "instrument", 4.0, "belowKeel", "d", place, tide(True), 1.5, {}, []),
        (T0 + 2, T0 + 5, "receipt", 4.0, "belowKeel", "d", None, tide(False), 1.5, {}, ["receipt-time-only"]),
    ]
    return spark.createDataFrame([(*r, None, None) for r in rows], journal.OBSERVATION)


def test_journal(spark):
    rows = observations(spark)
    evidence = [c for c in rows.columns if c != "received_at_ms"]
    j = journal.append(None, rows, evidence, ["observed_at_ms", "received_at_ms"])
    read = journal.read(j).orderBy("id").collect()
    assert [(r.id, r.corrected_m, r.corrected_datum, r.offsets_verified) for r in read] == [(1, 4.5, "MLLW", True), (2, None, None, False), (3, None, None, False)]
    again = journal.append(j, rows.withColumn("received_at_ms", F.lit(0).cast("long")), evidence, ["observed_at_ms", "received_at_ms"])
    assert again.count() == 0 and journal.status(j).first().last_id == 3
    with pytest.raises(ValueError):
        journal.read(j, limit=0)


def test_a_batch_is_held_against_its_own_days(spark, tmp_path):
    one = journal.Journal(spark, str(tmp_path / "j"))
    rows = observations(spark).withColumn("context", F.lit("v"))
    later = lambda days: rows.withColumn("observed_at_ms", F.col("observed_at_ms") + days * 86_400_000)
    for n, days in enumerate((0, 1, 40, 0)):
        one.add(later(days), n)
    assert one.read().count() == 9 and sorted(r.id for r in one.read().select("id").collect()) == [*range(1, 10)]
    given = later(0).withColumn("day", F.floor(F.col("observed_at_ms") / 86_400_000))
    near = one.of_days(one.head(), given)
    files = {r.f for r in near.select(F.input_file_name().alias("f")).collect()}
    assert files and {f.split("day=")[1].split("/")[0] for f in files} == {str(T0 // 86_400_000)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(observed_at_ms" in plan
    assert one.head()["facts"] == {"last_id": 9} and len(one.head()["tables"]["rows"]) == 3
    one.add(rows.limit(0), 9)
    assert one.read().count() == 9


def test_outbox(spark):
    j = journal.append(None, observations(spark), [c for c in journal.OBSERVATION.names if c != "received_at_ms"], ["observed_at_ms", "received_at_ms"]).cache()
    state: dict = {}
    box = journal.Outbox(j, state)
    with pytest.raises(PermissionError):
        box.prepare()
    box.consent(True)
    name, sample = box.prepare(2)
    assert len(sample["features"]) == 2 and sample["properties"]["throughId"] == 2 and box.prepare(2)[0] == name
    assert sample["features"][0]["geometry"]["coordinates"] == [-122.4, 37.8] and sample["features"][0]["properties"]["time"] == "2026-01-01T00:00:00.000Z"
    box.acknowledge(name)
    box.acknowledge(name)
    second, sample = box.prepare(2)
    assert sample["properties"]["scannedCount"] == 1 and sample["properties"]["excludedCount"] == 1
    with pytest.raises(ValueError):
        box.acknowledge("other")
    box.acknowledge(second)
    assert box.prepare(2)[0] is None and json.loads(json.dumps(state))["cursor"] == 3
    assert all("sample" not in b for b in state["batches"].values())


def fields(data: bytes):
    """(number, value) of a protocol buffer: ints, doubles and bytes."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            yield key >> 3, struct.unpack("<d", data[i : i + 8])[0]
            i += 8
        else:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n


def packed(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def layers(tile: bytes):
    for _, data in fields(tile):
        f = list(fields(data))
        keys = [v.decode() for n, v in f if n == 3]
        values = [next(iter(fields(v))) for n, v in f if n == 4]
        features = []
        for n, v in f:
            if n == 2:
                g = dict(fields(v))
                tags = packed(g[2])
                features.append(({keys[a]: values[b][1] for a, b in zip(tags[::2], tags[1::2], strict=True)}, g[3], packed(g[4])))
        yield dict(f)[1].decode(), dict(f)[5], features


def test_tiles_can_be_read_back():
    ring = [(10, 10), (20, 5), (15, -30)]
    got = list(layers(mvt.area_tile([({"a": 1.5, "b": "x", "c": True}, ring, (3, -4)), ({"a": 1.5}, ring, (0, 0))])))
    assert [(n, e, len(f)) for n, e, f in got] == [("DEPARE", 4096, 2), ("SOUNDG", 4096, 2)]
    properties, kind, g = got[0][2][0]
    assert properties == {"a": 1.5, "b": b"x", "c": 1} and kind == 3
    un = lambda z: (z >> 1) ^ -(z & 1)
    assert g[0] == 9 and [un(x) for x in g[1:3]] == [10, 10] and g[3] == 2 << 3 | 2 and [un(x) for x in g[4:8]] == [10, -5, -5, -35] and g[8] == 15
    assert got[1][2][0][1:] == (1, [9, 6, 7])
    dense = mvt.point_tile([({"DEPTH": float(i)}, (i % 4096, i // 4096)) for i in range(12_000)])
    assert len(dense) > 125_000


@pytest.fixture(scope="module")
def bathymetry(spark, sf):
    from leadline import fixtures as fx

    s = fx.soundings(spark, sf).cache()
    cells = surface.build_cells(s, C).cache()
    points = fx.crowd(spark, sf).filter("depth_mm > 0").withColumn("id", F.xxhash64("*")).cache()
    files = spark.createDataFrame([("a", "complete", 3, 7)], "name string, status string, invalid_count long, imported_at_ms long")
    return api.Bathymetry(C, s, surface.classify(s, C).cache(), cells, s.filter("id % 50 = 0").selectExpr("id original_id"), points, files)


def test_questions(spark, bathymetry):
    b, now = bathymetry, q.AS_OF
    assert b.status().first().superseded == 20 and b.soundings(limit=7).count() == 7
    box = (-122.4, 37.8, -122.399, 37.801)
    assert 0 < b.soundings(box, limit=10_000).count() < 980
    near = b.cells_in(box, now)
    assert 0 < near.count() < b.cells.count()
    assert b.cell_at(37.8, -122.4, now).count() == 1
    assert b.changes(now, since_ms=0).count() == b.cells.filter("change_state != 'stable'").count() and b.changes(now).count() == 0
    tile = b.tile(16, 10485, 25325, now, display="conservative").collect()
    names = {n: f for n, _, f in layers(bytes(tile[0].tile))}
    assert names["DEPARE"] and names["SOUNDG"][0][0]["BATHY_DISPLAY_KIND"] == b"conservative"
    assert b.tile(3, 0, 0, now).count() == 0
    wet = b.projection((1.2, 0.2), now).first()
    assert wet.projected_m == pytest.approx(wet.render_m + 1.2) and wet.under_keel_m == pytest.approx(wet.conservative_projected_m - 1.5)
    j = b.journeys()
    one = j.first()
    assert b.journey(one.vessel_id, one.journey_id, after=-(2**63), limit=1).count() == min(2, one.samples)
    assert b.crowd_soundings((-123, 37, -122, 38), limit=5).count() == 5 and b.crowd_status().first().files == 1
    assert b.crowd_tile(8, 40, 98).count() == 1 and b.reprocess(5).first().updated_at_ms == 5
    for bad in ((1, 2, 3), (1, 2, 0, 3), (0, 0, 181, 1), (0, 0, float("nan"), 1)):
        with pytest.raises(ValueError):
            b.cells_in(bad, now)
    for bad in ((25, 0, 0), (2, 4, 0), (2, 0.5, 0)):
        with pytest.raises(ValueError):
            b.crowd_tile(*bad)
    with pytest.raises(ValueError):
        api.check_span(0, 32 * 86_400_000)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(1000).selectExpr("id", "id as lat_e7", "id as lon_e7", "id as observed_at_ms").write.parquet(path)
    plan = spark.read.parquet(path).filter(listing.in_bbox((0.0, 0.0, 0.00001, 0.00001))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "LessThanOrEqual(lon_e7,100)" in plan and "observed_at_ms" not in plan


def test_functions_in_sql(spark):
    api.register_functions(spark)
    r = spark.sql("select half_up(-2.5D) a, datum_depth(5D, 1.5D, 1D) b, conservative_depth(5D, 1D) c, haversine_m(0D, 0D, 0D, 1D) d, recency(0, 0, 5D) e, mercator_x(180D) f, mercator_y(0D) g").first()
    assert (r.a, r.b, r.c, r.e) == (-2, 5.5, 3.355, 1.0) and r.d == pytest.approx(111195, abs=1) and r.f == pytest.approx(20037508.34, abs=0.01) and abs(r.g) < 1e-6


def test_style_and_chart():
    s = tiles.style(C, "/t")
    colour = s["layers"][0]["paint"]["fill-color"]
    assert colour[3::2] == [-1, 0, 1.125, 2.25, 4.5, 9.0, 18.0, 36.0]
    assert tiles.chart(C, (1, 2, 3, 4), "/t")["bounds"] == [0.99, 1.99, 3.01, 4.01] and tiles.chart(C, None, "/t")["bounds"] == [-180, -85, 180, 85]


def test_archive_of_files(spark, tmp_path):
    t = crowd.Archive(spark, str(tmp_path / "csb"))
    assert t.points() is None and t.manifest().count() == 0
    files = lambda *names: spark.createDataFrame([(n, "i", "p", "q", "r") for n in names], "name string, item_id string, platform string, provider string, instrument string")
    shape = "unique_id string, file_uuid string, longitude double, latitude double, depth_m double, observed_at_ms long, platform string, provider string, instrument string, is_valid boolean, file_name string"
    row = lambda name, d, ok=True: ("u", "f", 1.0, 2.0, float(d), 5, "p", "q", "r", ok, name)
    first = t.ingest(files("a", "b", "empty"), spark.createDataFrame([row("a", 1), row("a", 1), row("a", 2), row("a", 0, False), row("b", 3)], shape), 100)
    assert sorted((r.name, r.status, r.sounding_count, r.duplicate_count, r.invalid_count) for r in first.collect()) == [("a", "complete", 2, 1, 1), ("b", "complete", 1, 0, 0), ("empty", "complete", 0, 0, 0)]
    t.mark_full(files("a").select("name"))
    assert t.manifest().filter("is_full").count() == 1 and crowd.missing_files(files("a", "b", "c"), t.manifest(), full=True).count() == 2
    failed = t.mark_failed(files("b", "c").withColumn("error", F.lit("x" * 2000)))
    assert sorted((r.name, r.status, len(r.error)) for r in failed.collect()) == [("b", "failed", 1000), ("c", "failed", 1000)]
    assert t.points().count() == 3  # what b had stays
    t.ingest(files("a"), spark.createDataFrame([row("a", 9)], shape), 200)
    assert sorted((r.file_name, r.depth_m) for r in t.points().collect()) == [("a", 9.0), ("b", 3.0)]
    assert not t.manifest().filter("is_full").count() and tuple(t.progress().first()) == (4, 2, 2, 1, 0)
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.csv").write_text("LON,LAT,DEPTH,TIME\n")
    assert [(r.length, r.is_small) for r in crowd.small_files(spark, str(tmp_path / "files"), 5).collect()] == [(19, False)]


def test_boxes_by_ranges_of_the_curve(spark, tmp_path):
    from random import Random

    from leadline.operators import listing, places

    rng = Random(5)
    edges = [(lat, lon) for lat in (-900_000_000, 0, 900_000_000, None, 2_000_000_000) for lon in (-1_800_000_000, -1, 0, 1, 1_800_000_000, None)]
    some = [(rng.randrange(-900_000_000, 900_000_001), rng.randrange(-1_800_000_000, 1_800_000_001)) for _ in range(3000)] + [(rng.randrange(378_000_000, 379_000_000), rng.randrange(-1_225_000_000, -1_224_000_000)) for _ in range(3000)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(edges + some + some[:50])], "id long, lat_e7 long, lon_e7 long")
    keys = {r.id: r.place for r in places.with_place(rows).collect()}
    for i, (lat, lon) in enumerate(edges + some):
        if lat is None or lon is None:
            assert keys[i] is None
        elif lat <= 900_000_000:
            x, y = (lon + 1_800_000_000) // 2, lat + 900_000_000
            assert keys[i] == sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(31))
    places.write_by_place(rows, str(tmp_path / "t"), 8)
    stored = spark.read.parquet(str(tmp_path / "t"))
    boxes = [(-122.46, 37.83, -122.45, 37.84), (-180, -90, 180, 90), (-0.5, -0.5, 0.5, 0.5), (170, -90, 180, 0), (-122.4, 37.85, -122.4, 37.85), (5, 5, 4, 6)]
    for box in boxes:
        cover = places.cover(box)
        assert len(cover) <= places.MOST_RANGES and all(b < c for (_, b), (c, _) in zip(cover, cover[1:], strict=False))
        for most in (1, 24):
            assert sorted(r.id for r in places.within(stored, box, most).collect()) == sorted(r.id for r in rows.filter(listing.in_bbox(box)).collect())
    area = lambda box, most: sum(b - a + 1 for a, b in places.cover(box, most))
    exact = 50_000 * 100_000  # the first box in units of the key
    assert area(boxes[0], 24) < 2 * exact < area(boxes[0], 4) and places.cover(boxes[1]) and not places.cover(boxes[5])

    # the ranges reach the scan, and it reads few of the files' rows
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    near = places.within(stored, boxes[0])
    near.collect()
    plan = near._jdf.queryExecution().executedPlan()
    shown = plan.toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(place" in shown.split("PushedFilters")[1]
    scan = plan.collectLeaves().apply(0)
    assert 0 < scan.metrics().apply("numOutputRows").value() < rows.count() / 4
    assert places.within(rows, boxes[0]).count() == near.count() and places.within(stored.limit(0), boxes[0]).count() == 0


def test_an_archive_is_read_by_its_index(spark, tmp_path):
    from leadline.sources import archive

    record = lambda name, **k: {"attributes": {"NAME": name, "ITEM_ID": "i", **k}}
    names = [f"2024050{n}_{n}.tar.gz" for n in range(1, 8)]
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "page-2.json").write_text(json.dumps({"features": [record(n, PLATFORM="B", START_DATE=T0 if n < "20240506" else "soon") for n in names[2:]] + [record(names[0], PLATFORM="late"), record(None)]}))
    (tmp_path / "index" / "page-10.json").write_text(json.dumps({"features": [record(names[2], PLATFORM="later")]}))
    (tmp_path / "index" / "page-1.json").write_text(json.dumps({"features": [record(names[0], PLATFORM="A", PROVIDER="p"), record(names[1]), record("notes.txt")], "exceededTransferLimit": True}))
    (tmp_path / "index" / "page-3.json").write_text(json.dumps({"features": []}))
    index = archive.read_index(spark, str(tmp_path / "index"))
    files = crowd.discover(index).cache()
    got = {r.name: r for r in files.collect()}
    assert sorted(got) == names and [got[names[n]].platform for n in (0, 1, 2)] == ["A", "Unknown", "B"] and (got[names[2]].start_ms, got[names[6]].start_ms) == (T0, None)

    def put(n: int, text: str | bytes, ending: str = ".csv") -> None:
        folder = tmp_path / "csb" / "csv" / "2024" / "05" / f"0{n}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"2024050{n}_{n}{ending}").write_bytes(text if isinstance(text, bytes) else text.encode())

    put(1, CSV)
    put(2, b"\xef\xbb\xbfTIME,depth, LAT,LON,more\r\n2024-05-01T00:00:00Z,7,37.8,-122.4,\"a\nb\"\r\n\r\n2024-05-01T00:00:00Z,8\r\n", "_pointData.csv")
    put(3, "LON,LAT,DEPTH\n1,2,3\n")
    put(4, CSV * 100)
    put(5, "")
    put(6, "LON,LAT,DEPTH,TIME\n")
    table, box = crowd.Archive(spark, str(tmp_path / "table")), (-123, 37, -122, 38)
    manifest = {r.name: r for r in archive.take(table, files, str(tmp_path), box, 100, most_bytes=10_000).collect()}
    assert [manifest[n].status for n in names] == ["complete", "complete", "failed", "failed", "failed", "complete", "failed"]
    assert [manifest[n].sounding_count for n in (names[0], names[1], names[5])] == [1, 1, 0] and manifest[names[0]].invalid_count == 1
    assert all(word in manifest[names[n]].error for n, word in ((2, "TIME"), (3, "over 10000"), (4, "LON"), (6, "no CSV")))
    assert sorted((r.file_name, r.depth_m, r.platform, r.provider) for r in table.points().collect()) == [(names[0], 12.5, 'Boat, "B"', "p"), (names[1], 7.0, "Unknown", "Unknown")]

    # a file that breaks keeps what it had; one that is mended comes in
    put(1, "LON\n1\n")
    put(3, CSV)
    again = {r.name: r.status for r in archive.take(table, files.filter(F.col("name").isin(names[0], names[2])), str(tmp_path), box, 200).collect()}
    assert again == {names[0]: "failed", names[2]: "complete"}
    assert sorted(r.file_name for r in table.points().collect()) == names[:3]
    none = archive.take(table, files.limit(0), str(tmp_path), box, 300)
    assert none.count() == 0 and table.points().count() == 3
    (tmp_path / "index" / "page-4.json").write_text(json.dumps({"error": {"message": "busy"}}))
    with pytest.raises(Exception, match="busy"):
        archive.read_index(spark, str(tmp_path / "index")).collect()


def test_history_responses(spark):
    body = {"context": "v", "values": [{"path": "d", "method": "first"}, {"path": "p", "method": "first"}], "data": [["2026-01-01T00:00:01Z", "5.5", '{"latitude": 1, "longitude": 2}'], ["bad", "1", None], ["2026-01-01T00:00:00Z", "NaN", "[2.5, 1.5]"], ["2026-01-01T00:00:03Z", None, "x"]]}
    r = spark.createDataFrame([json.dumps(body)], "string").select(F.from_json("value", deltas.RESPONSE).alias("r")).select("r.*")
    assert [tuple(x) for x in deltas.history_series(r, "d", method="first").collect()] == [("v", T0 + 1000, 5.5)]
    assert sorted((x.at_ms, x.latitude, x.longitude) for x in deltas.history_series(r, "p", is_position=True).collect()) == [(T0, 1.5, 2.5), (T0 + 1000, 1.0, 2.0)]
    assert deltas.history_series(r, "other").count() == 0
    with pytest.raises(Exception, match="not average"):
        deltas.history_series(r, "d", method="average").collect()


def test_series_of_stored_values(spark):
    rows = [("v", p, T0 + 1000 * i + ms, str(v)) for i in range(3) for p, ms, v in (("d", 100, 5 + i), ("d", 600, 99), ("h", 0, 0.5), ("s", 0, 2), ("t", 0, "NaN"), ("a", 0, json.dumps({"roll": 0.1 * i, "pitch": None})), ("p", 0, json.dumps([-122.4, 37.8])))]
    values = spark.createDataFrame([*rows, ("v", "d", T0 + 900_000, "1"), ("v", "d", T0, None)], "context string, path string, at_ms long, value string")
    read = rebuild.series_reader(values, {"depth": "d", "position": "p", "attitude": "a", "heading": "h", "speed": "s", "tide": "t"}, C)
    got = {n: sorted(map(tuple, df.collect())) for n, df in read(T0, T0 + 10_000).items()}
    assert set(got) == set(rebuild.CHANNELS) and got["depth"] == [("v", T0 + 1000 * i, 5.0 + i) for i in range(3)]
    assert [len(got[n]) for n in ("heading", "speed", "tide", "roll", "pitch", "position")] == [3, 3, 0, 3, 0, 3] and got["position"][0][2:] == (37.8, -122.4)
    with pytest.raises(ValueError):
        rebuild.series_reader(values, {}, Config(history_resolution_s=5))


def test_text_that_may_be_broken(spark):
    from leadline.functions import depth, text

    df = spark.createDataFrame([(t,) for t in ('["a", 1]', '{"a": 1}', "[1", None, "5", ' ["x"]')], "t string")
    assert [r[0] for r in df.select(text.json_array("t")).collect()] == [["a", "1"], [], [], [], [], ["x"]]
    one = spark.createDataFrame([('{"a": {"b.c": 1, "b": {"c": [7]}}}',)], "t string")
    assert one.select(text.json_at("t", "a.b.c"), text.json_at("t", "a.x")).first()[:] == ("[7]", None)
    doc = lambda **d: json.dumps({"name": "mine", "categories": {"depth": {"baseUnit": "m", "targetUnit": "foot", "formula": "value * 3.28084", "symbol": "ft", "displayFormat": "0.0"} | d}})
    docs = spark.createDataFrame([(doc(),), (doc(baseUnit="ft"),), (doc(formula="x"),), ("{}",), ("no",)], "d string")
    got = [r.u for r in docs.select(depth.unit_preference("d").alias("u")).collect()]
    assert (got[0].unit, got[0].symbol, got[0].decimals, got[0].factor, got[0].name) == ("foot", "ft", 1, 3.28084, "mine") and got[1:] == [None] * 4


#: Settings under which the small table has confirmed changes.
K = Config(change_min_passes=1, change_min_days=0.0)


def contents(surface_) -> dict[str, list]:
    """What a reader sees of a surface, but for times of update and parts."""
    leave = {"seq", "area", "updated_at_ms", "changed_at_ms"}
    rows = lambda df: sorted(map(str, df.select(sorted(set(df.columns) - leave)).collect()))
    return {n: rows(df) for n in ("cells", "qc", "history", "soundings", "active") if (df := getattr(surface_, n)()) is not None}


def _two_batches(spark, sf):
    from leadline import fixtures as fx

    s = fx.soundings(spark, sf, 60.0).withColumn("fingerprint", F.sha2(F.col("id").cast("string"), 256))
    # from the cut on, every other cell is five metres deeper
    s = s.withColumn("datum_depth_mm", F.col("datum_depth_mm") + F.when((F.col("observed_at_ms") >= q.CUT) & (F.col("cell_x") % 2 == 0), 5000).otherwise(0))
    return s, s.filter(F.col("observed_at_ms") < q.CUT), s.filter(F.col("observed_at_ms") >= q.CUT)


def test_cells_from_a_stream(spark, sf, tmp_path):
    """Two files as two micro-batches give what two batches give; batches that come again change nothing."""
    from leadline.plans.store import apply_batch

    s, first, second = _two_batches(spark, sf)
    for n, part in enumerate((first, second.unionByName(first.limit(3)))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sf_ = stream_cells.Surface(spark, str(tmp_path / "out"), K)
        stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
        stream_cells.maintain(stream, sf_, str(tmp_path / "check"), clock=lambda n: n).awaitTermination()
    got = sf_.cells()
    want, qc, history = apply_batch(surface.build_cells(first, K), s, second, K, 1)
    columns = [c for c in want.columns if c not in ("updated_at_ms", "previous_depth_mm")]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0 == want.select(columns).exceptAll(got.select(columns)).count()
    seen = contents(sf_)
    assert len(seen["soundings"]) == len(seen["qc"]) == s.count() and len(seen["history"]) == history.count() > 0
    for batch, n, source in ((second, 1, str(tmp_path / "check")), (first, 0, str(tmp_path / "check")), (second, 0, "another"), (s.limit(0), 1, "another")):
        sf_.apply(batch, n, 9, source)
        assert contents(sf_) == seen


def test_a_batch_that_was_cut_short_is_taken_whole(spark, sf, tmp_path, monkeypatch):
    s, first, second = _two_batches(spark, sf)
    whole = stream_cells.Surface(spark, str(tmp_path / "whole"), K)
    whole.apply(first, 0, 0)
    between = contents(whole)
    whole.apply(second, 1, 1)
    torn, write, left = stream_cells.Surface(spark, str(tmp_path / "torn"), K), stream_cells.Surface.write, [0]
    torn.apply(first, 0, 0)

    def cut_short(self, *args, **kw):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("lost")
        return write(self, *args, **kw)

    monkeypatch.setattr(stream_cells.Surface, "write", cut_short)
    for k in (1, 3, 5):  # before passes, before cells, before history
        left[0] = k
        with pytest.raises(OSError):
            torn.apply(second, 1, 1)
        assert contents(torn) == between
    left[0] = 99
    torn.apply(second, 1, 1)
    assert contents(torn) == contents(whole)


def test_two_writers_of_one_surface(spark, sf, tmp_path):
    """Whoever commits second builds its batch anew on what the first has left, and neither loses a sounding."""
    s, first, second = _two_batches(spark, sf)
    for k, (one, other) in enumerate(((first, second), (second, first))):
        path = str(tmp_path / f"both{k}")
        a, b = stream_cells.Surface(spark, path, K), stream_cells.Surface(spark, path, K)
        committed, add = [], a.commits.add

        def slow(seq, content, b=b, other=other, add=add, committed=committed):
            if not committed:  # between a's work and its commit, b commits
                committed.append(seq)
                b.apply(other, 0, 1, "other")
            add(seq, content)

        a.commits.add = slow
        a.apply(one, 0, 1, "one")
        alone = stream_cells.Surface(spark, str(tmp_path / f"alone{k}"), K)
        alone.apply(other, 0, 1, "other")
        alone.apply(one, 0, 1, "one")
        assert committed == [0] and contents(a) == contents(alone) and a.soundings().count() == s.count()
        assert a.head()["sources"] == {"other": 0, "one": 0}


def test_a_surface_of_many_batches_has_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FAN", 2)
    monkeypatch.setattr(store, "KEEP", 2)
    kind = "id long, observed_at_ms long, cell_x long, cell_y long, tide_datum string, pass_id string, datum_depth_mm long, vertical_sigma_mm long, horizontal_sigma_mm long, depth_source string, sample_count long, fingerprint string"
    rows = [(i, T0 + i, i % 3, 0, "MLLW", f"p{i % 2}", 5000 + i % 4, 300, 1000, "a", 1, f"f{i}") for i in range(12)]
    one = stream_cells.Surface(spark, str(tmp_path / "many"), K)
    most = 0
    for n in range(6):
        one.apply(spark.createDataFrame(rows[2 * n : 2 * n + 2], kind), n, n)
        most = max(most, *map(len, one.head()["tables"].values()))
    want = {(r.cell_x, r.robust_depth_mm, r.sounding_count, r.pass_count) for r in surface.build_cells(spark.createDataFrame(rows, kind), K).collect()}
    assert {(r.cell_x, r.robust_depth_mm, r.sounding_count, r.pass_count) for r in one.cells().collect()} == want
    folders = {n: len([*(tmp_path / "many" / n).iterdir()]) for n in ("soundings", "passes", "cells", "states")}
    assert most <= 3 and all(n <= most + 2 * 3 for n in folders.values()) and not [*(tmp_path / "many" / "_passes").iterdir()]
    assert one.commits.last()["seq"] == 5 and one.qc().count() == 12


def test_replaced_soundings_leave_no_trace_in_cells(spark, sf, tmp_path):
    s, first, second = _two_batches(spark, sf)
    one = stream_cells.Surface(spark, str(tmp_path / "one"), K)
    one.apply(s, 0, 0)
    # all soundings of one cell move a hundred cells on, and some others get deeper where they are
    place = s.groupBy("cell_x", "cell_y").count().orderBy("cell_x", "cell_y").first()
    moved = s.filter((F.col("cell_x") == place.cell_x) & (F.col("cell_y") == place.cell_y)).withColumn("cell_x", F.col("cell_x") + 100)
    deeper = s.filter((F.col("cell_x") != place.cell_x) & (F.col("id") % 50 == 0)).withColumn("datum_depth_mm", F.col("datum_depth_mm") + 700)
    new = moved.unionByName(deeper).withColumns({"replaces_id": F.col("id"), "id": F.col("id") + 10**9, "position_method": F.lit("history_geometry_v1"), "fingerprint": F.sha2(F.concat(F.lit("new"), "id"), 256)})
    one.replace(new, "job", 5)
    active = s.join(new.select(F.col("replaces_id").alias("id")), "id", "left_anti").unionByName(new.select(s.columns))
    columns = [c for c in one.cells().columns if c not in ("updated_at_ms", "previous_depth_mm")]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(one.cells()) == rows(surface.build_cells(active, K)) and one.active().count() == s.count()
    assert not one.cells().filter((F.col("cell_x") == place.cell_x) & (F.col("cell_y") == place.cell_y)).count()
    seen = contents(one)
    one.replace(new, "job", 6)
    assert contents(one) == seen
    with pytest.raises(ValueError):
        one.replace(new, "twice", 7)  # what they replace is no longer active
    assert contents(one) == seen


def test_live_stream_to_cells_and_journal(spark, tmp_path):
    """Raw deltas go through pairing into a surface and a journal."""
    paths = {"nav.position": "position", "env.depth": "depth", "env.tide": "tide", "nav.sog": "sog", "nav.attitude": "attitude"}
    iso = lambda t: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(t / 1000)) + f".{t % 1000:03}Z"
    lines = []
    for i in range(30):
        t = T0 + 1000 * i
        values = [("env.tide", 1.0), ("nav.sog", 2.0), ("nav.attitude", {"roll": 0.1, "pitch": 0.0}), ("nav.position", {"latitude": 37.8 + i * 1e-4, "longitude": -122.4}), ("env.depth", 5.0 if i else 500.0)]
        lines += [{"context": "v", "updates": [{"timestamp": iso(t), "$source": p, "values": [{"path": p, "value": v}]}]} for p, v in values]
        lines.append({"context": "w", "updates": [{"timestamp": iso(t), "$source": "d", "values": [{"path": "env.depth", "value": 5.0}]}]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    values = deltas.flatten(deltas.stream(spark, str(tmp_path / "in")))
    readings = live.readings_of(values, paths, F.col("at_ms"))
    sf_, log = stream_cells.Surface(spark, str(tmp_path / "out"), C), journal.Journal(spark, str(tmp_path / "journal"))
    counts = []
    query = live.record(readings, C, sf_, log, str(tmp_path / "check"), told=lambda n, seen: counts.append(seen))
    # timers in processing time keep such a query running, so it is stopped from outside
    until = time.time() + 120
    try:
        while time.time() < until and query.exception() is None and not any(p.numInputRows == 0 for p in query.recentProgress):
            time.sleep(1)
    finally:
        query.stop()
    s = sf_.soundings().collect()
    assert len(s) == 29 and {r.context for r in s} == {"v"} and {r.datum_depth_mm for r in s} == {4500} and {r.position_method for r in s} == {"exact"}
    assert {r.pass_id for r in s} == {"2026-01-01:v-0"} and len({r.fingerprint for r in s}) == 29 and sf_.cells().agg(F.sum("sounding_count")).first()[0] == 29
    j = log.read().orderBy("id").collect()
    assert [r.id for r in j] == [*range(1, 61)] and sum("missing-position" in r.quality for r in j) == 30 and sum("outside-instrument-range" in r.quality for r in j) == 1
    assert journal.with_corrections(log.read()).filter("corrected_m = 4.5").count() == 29
    turned = next(r for r in j if r.context == "v" and r.observed_at_ms == T0 + 5000)
    assert turned.attitude.roll_rad == 0.1 and turned.attitude.source == "nav.attitude" and turned.tide.source == "env.tide" and turned.heading is None and turned.installation["offsetsVerified"] == "false"
    total = {k: sum(c[k] for c in counts) for k in counts[0]}
    assert total["raw"] == 60 and total["soundings"] == 29 and total["withheld_geometry"] == 0
    # history knows the vessel's attitude: a first run that is stopped, a second one, a third that finds all done
    at = lambda v: spark.createDataFrame([("v", T0 + 1000 * i, float(v)) for i in range(60)], "context string, at_ms long, value double")
    fixes = spark.createDataFrame([("v", T0 + 1000 * i, 37.8 + i * 1e-4, -122.4) for i in range(60)], "context string, at_ms long, latitude double, longitude double")
    series = {"depth": at(5), "position": fixes, "roll": at(0.1), "pitch": at(0), "heading": at(0), "speed": at(2), "tide": at(1)}
    read, stops = (lambda a, b: series), iter([False, True])
    run = lambda stop: rebuild.rebuild_history(sf_, read, T0, T0 + 30_000, 7, chunk_ms=16_000, stop=stop)
    assert rebuild.chunks(0, 40, 16) == [(0, 16), (16, 32), (32, 40)] and rebuild.chunks(5, 5) == []
    assert run(lambda: next(stops)) == 1 and run(lambda: False) == len(rebuild.chunks(T0, T0 + 30_000, 16_000)) == run(lambda: False)
    active = sf_.active().collect()
    assert len(active) == 29 and {r.datum_depth_mm for r in active} == {round(5000 * math.cos(0.1)) - 500} and {r.position_method for r in active} == {"history_geometry_v1"}
    assert sf_.cells().agg(F.sum("sounding_count")).first()[0] == 29 and sf_.soundings().count() == 58
    log.add(log.read().drop("id", "fingerprint"), 0, str(tmp_path / "check"))
    assert log.read().count() == 60 and live.readings_of(deltas.flatten(deltas.read(spark, str(tmp_path / "in"))), paths, F.lit(1), "lat", "MLLW").filter("path = 'tide'").count() == 0


def test_a_sheet_has_all_tiles_and_touched_ones_are_enough(spark, bathymetry):
    b, now, zooms = bathymetry, q.AS_OF, (7, 16, 18, 20)
    shown = b.shown(now).cache()
    sheet = {(r.z, r.x, r.y): bytes(r.tile) for r in tiles.encode_areas(tiles.sheet_rows(tiles.display_levels(shown, C, zooms), C, zooms)).collect()}
    assert {z for z, _, _ in sheet} == {16, 18, 20} and len({k for k in sheet if k[0] == 20}) > 20
    assert {k[1:] for k in sheet if k[0] == 16} == {(r.x, r.y) for r in b.sheet(16, 16, now).collect()} and (10485, 25325) in {k[1:] for k in sheet if k[0] == 16}

    # what lies in the square of a tile by itself is in the sheet's as well
    def inside(tile: bytes) -> set:
        return {(p["BATHY_CELL_X"], p["BATHY_CELL_Y"], p["DEPTH"], p["BATHY_CONFIDENCE"], at[0]) for layer, p, at in mvt.features(tile) if layer == "SOUNDG" and all(0 <= v < 4096 for v in at[0])}

    for z, x, y in [(16, 10485, 25325), *[k for k in sheet if k[0] == 18][:2]]:
        assert inside(bytes(b.tile(z, x, y, now).first().tile)) == inside(sheet[z, x, y])

    # some cells go, one by one tile; the rest of the sheet stays as it is
    gone = b.cells.orderBy("cell_x", "cell_y").limit(3).select(*surface.CELL).cache()
    left = surface.with_neighbours(surface.read_cells(b.cells.join(gone, surface.CELL, "left_anti"), C, now), C).cache()
    encoded = lambda only: {(r.z, r.x, r.y): bytes(r.tile) for r in tiles.encode_areas(tiles.sheet_rows(tiles.display_levels(left, C, zooms), C, zooms, only=only)).collect()}
    touched = tiles.touched_tiles(gone, C, zooms)
    keys = {tuple(r) for r in touched.collect()}
    assert 0 < len(keys & sheet.keys()) < len(sheet)
    assert {k: v for k, v in sheet.items() if k not in keys} | encoded(touched) == encoded(None)
    assert tiles.decode(b.sheet(16, 16, now).limit(0)).count() == 0 and b.sheet(0, 7, now).count() == 0
    with pytest.raises(ValueError):
        b.sheet(9, 8, now)


def test_tiles_are_decoded_as_they_were_written():
    ring = [(10, 10), (20, 5), (15, -30)]
    tile = mvt.area_tile([({"a": 1.5, "b": "x", "c": True, "d": -2.0}, ring, (3, -4)), ({"a": 1.5}, ring, (0, 0)), ({}, ring, (-5000, 9000))])
    assert list(mvt.features(tile)) == [(layer, p, points) for layer, k in (("DEPARE", 0), ("SOUNDG", 1)) for p, points in (({"a": 1.5, "b": "x", "c": True, "d": -2.0}, [ring, [(3, -4)]][k]), ({"a": 1.5}, [ring, [(0, 0)]][k]), ({}, [ring, [(-5000, 9000)]][k]))]
    assert not list(mvt.features(mvt.area_tile([]))) and not list(mvt.features(b""))
