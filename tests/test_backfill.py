"""History into a surface by chunks: any length of chunk gives the soundings of one run."""

import random

import pytest
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.plans import backfill
from leadline.streaming.cells import Surface

T0, MINUTE, HOUR = 1_767_225_600_000, 60_000, 3_600_000
C = Config(history_resolution_s=60, minimum_speed_mps=1.0, stationary_window_s=600.0, stationary_min_samples=3, base_cell_m=50.0)
PATHS = {"depth": "d", "position": "p", "tide": "t", "speed": "s"}


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(3)
    rows = []
    for context in ("v", "w"):
        tide, fast = 1.0, False
        for i in range(26 * 60):
            t = T0 + i * MINUTE + r.randrange(MINUTE)
            fast = not fast if r.random() < 0.03 else fast
            tide += r.uniform(-0.02, 0.02)
            rows.append((context, "p", t, f'{{"latitude":{37.8 + i * 1e-4},"longitude":-122.4}}'))
            rows += [(context, "d", t + k, str(round(5 + r.random(), 3))) for k in range(1 + i % 2) if r.random() > 0.05]
            # at times a tide that can't be
            rows.append((context, "t", t, str(round(tide + (3 if r.random() < 0.02 else 0), 3))))
            rows.append((context, "s", t, str(2.0 if fast else 0.1)))
    return spark.createDataFrame(rows, "context string, path string, at_ms long, value string").repartition(4).cache()


class Rows:
    """What a surface is to a backfill."""

    def __init__(self, spark, path, config=C):
        self.spark, self.path, self.config, self.seen, self.done = spark, path, config, [], -1

    def has(self, name, number=0):
        return self.done >= number

    def active(self):
        return None

    def apply(self, rows, number, updated_at_ms, name):
        self.seen += rows.collect()
        self.done = number


def plain(rows):
    return sorted((r.context, r.observed_at_ms, r.aggregation_kind, r.track, r.sample_count, r.rejected_sample_count, r.datum_depth_mm, r.window_start_ms, r.fingerprint) for r in rows)


def test_any_chunk_gives_the_soundings_of_one_run(spark, values, tmp_path):
    read = backfill.history_reader(values, PATHS, C)
    end, got = T0 + 25 * HOUR + 17_000, {}
    for hours in (6, 24):
        out = Rows(spark, str(tmp_path / str(hours)))
        assert backfill.backfill(out, read, T0 + 5000, end, 1, chunk_ms=hours * HOUR) == out.done + 1
        got[hours] = plain(out.seen)
    whole = plain(backfill.backfilled(values, PATHS, T0 + 5000, end, C).collect())
    kinds = {x[2] for x in whole}
    assert got[6] == got[24] == whole and kinds == {"point", "stationary_window"} and len(whole) > 800


def test_chunks_shorter_than_a_window(spark, values, tmp_path):
    read = backfill.history_reader(values, PATHS, C)
    out = Rows(spark, str(tmp_path))
    backfill.backfill(out, read, T0, T0 + HOUR // 2, 1, chunk_ms=7 * MINUTE)
    assert plain(out.seen) == plain(backfill.backfilled(values, PATHS, T0, T0 + HOUR // 2, C).collect())


def test_a_job_goes_on_where_it_was(spark, values, tmp_path):
    read = backfill.history_reader(values, PATHS, C)
    s = Surface(spark, str(tmp_path / "s"), C)
    stops = iter([False, True])
    run = lambda stop: backfill.backfill(s, read, T0, T0 + 2 * HOUR, 1, chunk_ms=HOUR, stop=stop)
    assert run(lambda: next(stops)) == 1 and s.soundings().agg(F.max("observed_at_ms")).first()[0] < T0 + HOUR
    assert run(lambda: False) == 2 == run(lambda: False)
    want = plain(backfill.backfilled(values, PATHS, T0, T0 + 2 * HOUR, C).collect())
    assert plain(s.soundings().collect()) == want and s.cells().count() > 0


def test_what_a_backfill_refuses(spark, values, tmp_path):
    read = backfill.history_reader(values, PATHS, C)
    out = Rows(spark, str(tmp_path))
    for a, b in ((5, 5), (0, 32 * 24 * HOUR)):
        with pytest.raises(ValueError):
            backfill.backfill(out, read, a, b, 1)
    fixed = Rows(spark, str(tmp_path), Config(attitude_correction=True))
    fixed.active = lambda: spark.createDataFrame([(7,)], "observed_at_ms long")
    with pytest.raises(ValueError, match="rebuild"):
        backfill.backfill(fixed, read, 0, 10, 1)
    with pytest.raises(ValueError, match="below the transducer"):
        backfill.backfill(fixed, read, 20, 30, 1, reference="belowKeel")


def test_history_with_attitude(spark, tmp_path):
    at = lambda v: spark.createDataFrame([("v", T0 + 1000 * i, float(v)) for i in range(90)], "context string, at_ms long, value double")
    places = spark.createDataFrame([("v", T0 + 1000 * i, 37.8 + i * 1e-4, -122.4) for i in range(90)], "context string, at_ms long, latitude double, longitude double")
    series = {"depth": at(5), "position": places, "roll": at(0.1), "pitch": at(0), "heading": at(0), "speed": at(2), "tide": at(1)}
    out = Rows(spark, str(tmp_path), Config(attitude_correction=True))
    backfill.backfill(out, lambda a, b: series, T0, T0 + 60_000, 1, chunk_ms=25_000)
    assert len(out.seen) == 60 and {r.position_method for r in out.seen} == {"history_geometry_v1"} and {r.aggregation_kind for r in out.seen} == {"point"}
