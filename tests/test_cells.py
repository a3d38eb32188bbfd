"""Cells: known cases of behaviour, and a plain model on random soundings."""

import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from leadline.config import Config, depth_reference
from leadline.functions import geo
from leadline.operators import listing, surface
from leadline.plans import store

DAY = 86_400_000
T0 = 1_767_225_600_000  # 2026-01-01
CONFIG = Config(base_cell_m=10.0, recency_half_life_days=100_000.0)
SCHEMA = "id long, observed_at_ms long, cell_x long, cell_y long, tide_datum string, pass_id string, datum_depth_mm long, vertical_sigma_mm long, horizontal_sigma_mm long, depth_source string, sample_count long"
HERE = geo.cell_of(37.8, -122.4, 10.0)


def sounding(id, depth, day=0, pass_id=None, cell=HERE, source="a", sigma_h=1000, sigma=300):
    return (id, T0 + int(day * DAY), *cell, "MLLW", pass_id or f"p{id}", int(depth * 1000), sigma, sigma_h, source, 1)


def shown(spark, rows, config=CONFIG, previous=None):
    s = spark.createDataFrame(rows, SCHEMA)
    cells = surface.build_cells(s, config, previous)
    return {(r.cell_x, r.cell_y): r for r in surface.with_neighbours(surface.read_cells(cells, config, T0 + 30 * DAY), config).collect()}


def test_one_sounding(spark):
    r = shown(spark, [sounding(1, 5.5)])[HERE]
    assert r.robust_m == 5.5 and r.confidence <= 0.25 and r.reasons[:2] == ["single_observation", "single_pass"]


def test_shoaling_then_confirmed(spark):
    deep = [sounding(i, 5 + i / 100, day=i - 1) for i in (1, 2, 3)]
    first = shown(spark, [*deep, sounding(4, 3, day=3)])[HERE]
    assert first.change_state == "suspected_shoaling" and first.robust_m > 4.9 and first.render_m == 3
    before = surface.build_cells(spark.createDataFrame([*deep, sounding(4, 3, day=3)], SCHEMA), CONFIG)
    rows = [*deep, *[sounding(4 + i, 3, day=3 + i) for i in range(3)]]
    s = spark.createDataFrame(rows, SCHEMA)
    r = surface.build_cells(s, CONFIG, before).collect()[0]
    assert r.change_state == "confirmed" and r.robust_depth_mm == 3000 and r.pass_count == 3
    assert surface.history_of(surface.build_cells(s, CONFIG, before)).collect()[0].new_depth_mm == 3000
    qc = [x.qc_state for x in surface.classify(s, CONFIG, before).collect()]
    assert qc.count("quarantined") == 3


def folds_of(rows):
    """How often the plan has the fold over a cell's passes."""
    return rows._jdf.queryExecution().optimizedPlan().toString().count("sequence(1, (size(")


def test_changed_cells_are_worked_out_once(spark):
    cells = surface.build_cells(spark.createDataFrame([sounding(i, 5 - 2 * (i == 3), day=i) for i in range(4)], SCHEMA), CONFIG, updated_at_ms=7)
    changed = listing.changes(cells, 7, "MLLW")
    assert folds_of(changed) == 1
    assert [r.change_state for r in changed.collect()] == ["suspected_shoaling"] and listing.changes(cells, 8, "MLLW").count() == 0
    after = surface.build_cells(spark.createDataFrame([sounding(i, 3, day=i) for i in range(4)], SCHEMA), CONFIG, cells, 8)
    assert folds_of(surface.history_of(after)) == 2  # the cells before are worked out too
    assert [r.new_depth_mm for r in surface.history_of(after).collect()] == [3000]


def test_the_newest_changes_are_worked_out_once(spark):
    rows = [sounding(10 * k + i, 5 - 2 * (i == 3), day=i, cell=(HERE[0] + k, HERE[1])) for k in range(3) for i in range(4)]
    newest = listing.changes(surface.build_cells(spark.createDataFrame(rows, SCHEMA), CONFIG, updated_at_ms=7), 0, "MLLW", 2)
    assert folds_of(newest) == 1
    assert [r.cell_x - HERE[0] for r in newest.collect()] == [0, 1]


def test_clusters_are_worked_out_once(spark):
    s = spark.createDataFrame([sounding(i, 5 - 2 * (i == 3), day=i) for i in range(4)], SCHEMA)
    clusters = surface.cell_clusters(surface.pass_estimates(s), CONFIG).select(*surface.CELL, F.explode("clusters").alias("c"))
    assert folds_of(clusters) == 1
    assert sorted((r.c.k, r.c.centre_m, r.c.n) for r in clusters.collect()) == [(0, 3.0, 1), (1, 5.0, 3)]


def test_a_weak_cell_beside_strong_ones(spark):
    x, y = HERE
    around = [(x + 1, y), (x, y + 1), (x - 1, y)]
    rows = [sounding(10 * k + i, 5, day=i, cell=c, source="ab"[i % 2]) for k, c in enumerate(around, 1) for i in range(6)]
    r = shown(spark, [*rows, sounding(1, 10)])[HERE]
    assert r.neighbour_delta_m > 4 and r.confidence <= 0.12 and "neighbor_depth_disagreement" in r.reasons and r.neighbour_support == 3


def test_a_position_too_coarse_for_its_cell(spark):
    r = shown(spark, [sounding(i, 5, day=i, source="ab"[i % 2], sigma_h=20_000) for i in range(12)])[HERE]
    assert r.confidence < 0.05 and "horizontal_uncertainty_exceeds_cell" in r.reasons


def robust(xs):
    m = median(xs)
    return 0.0 if len(xs) < 2 else 1.4826 * median([abs(x - m) for x in xs])


def plain_cell(rows, floor=0.5):
    """Every cluster is tried for every pass, in order of depth."""
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append(r)
    passes = sorted((median([r[6] / 1000 for r in p]), k, min(r[1] for r in p), max(r[1] for r in p)) for k, p in by.items())
    clusters = []
    for p in passes:
        for c in clusters:
            if abs(median([x[0] for x in c]) - p[0]) <= floor:
                c.append(p)
                break
        else:
            clusters.append([p])
    active = min(clusters, key=lambda c: (-len(c), -max(p[3] for p in c)))
    centre = lambda c: median([p[0] for p in c])
    others = [c for c in clusters if c is not active]
    shallow = min((c for c in others if centre(c) < centre(active) - floor), key=centre, default=None)
    deep = [c for c in others if centre(c) > centre(active) + floor and max(p[3] for p in c) > max(p[3] for p in active)]
    held = shallow or active
    own = [r for p in held for r in by[p[1]]]
    sigma = math.sqrt(median([r[7] / 1000 for r in own]) ** 2 + (robust([p[0] for p in held]) ** 2 + median([robust([r[6] / 1000 for r in by[p[1]]]) for p in held]) ** 2) / len(held))
    state = "suspected_shoaling" if shallow else "candidate_deepening" if deep else "stable"
    return round(centre(active) * 1000, 3), round(centre(held) * 1000, 3), state, sigma


def test_cells_are_the_plain_ones(spark):
    rng = random.Random(4)
    rows = [sounding(i, rng.choice([3, 4, 4.4, 5, 5.5]) + rng.random() / 2, day=rng.random() * 9, pass_id=f"p{rng.randrange(9)}", cell=(rng.randrange(12), 0), sigma=rng.randrange(100, 400)) for i in range(500)]
    got = {r.cell_x: r for r in surface.build_cells(spark.createDataFrame(rows, SCHEMA), CONFIG).collect()}
    for x in range(12):
        robust_mm, render_mm, state, sigma = plain_cell([r for r in rows if r[2] == x])
        r = got[x]
        assert (abs(r.robust_depth_mm - robust_mm) <= 0.51, abs(r.render_depth_mm - render_mm) <= 0.51, r.change_state) == (True, True, state)
        assert r.vertical_sigma_mm == pytest.approx(sigma * 1000, abs=0.51)


def test_order_and_repetition_don_t_matter(spark):
    rng = random.Random(9)
    rows = [sounding(i, 4 + rng.random(), day=rng.random() * 5, pass_id=f"p{i % 7}", cell=(i % 3, 1)) for i in range(90)]
    a = surface.build_cells(spark.createDataFrame(rows, SCHEMA), CONFIG)
    rng.shuffle(rows)
    s = spark.createDataFrame(rows, SCHEMA)
    b = surface.build_cells(s, CONFIG)
    assert a.exceptAll(b).count() == 0
    none = surface.build_cells(s.filter("false"), CONFIG)
    cells, _, history = store.apply_batch(none, s, s, CONFIG, 0)
    assert cells.exceptAll(b).count() == 0 == history.count()


def test_an_overview_is_led_by_its_shallowest(spark):
    x, y = geo.cell_of(37.8, -122.4, 10.0)
    rows = [sounding(10 * k + i, d, day=i, cell=(x + k, y)) for k, d in enumerate((5, 5, 5, 3)) for i in range(3)]
    cells = surface.read_cells(surface.build_cells(spark.createDataFrame(rows, SCHEMA), CONFIG), CONFIG, T0 + DAY)
    low = cells.orderBy("conservative_m").first()
    top = surface.overview(cells, 10.0, 640.0).collect()
    assert len(top) == 1 and top[0].render_m == 3 and top[0].confidence == low.confidence and top[0].sounding_count == 12


def test_replacements_are_all_or_nothing(spark):
    old = spark.createDataFrame([(1, 100, "MLLW"), (2, 200, "MLLW")], "id long, observed_at_ms long, tide_datum string").selectExpr("*", "cast(0 as long) cell_x", "cast(0 as long) cell_y", "'exact' position_method")
    new = spark.createDataFrame([(11, 100, "MLLW", 1)], "id long, observed_at_ms long, tide_datum string, replaces_id long").selectExpr("*", "cast(3 as long) cell_x", "cast(0 as long) cell_y", "'history_geometry_v1' position_method")
    links = spark.createDataFrame([], "original_id long, replacement_id long")
    stored, links, cells = store.replace_from_history(old, links, new)
    assert stored.count() == 3 and surface.active_soundings(stored, links).count() == 2 and {r.cell_x for r in cells.collect()} == {0, 3}
    for wrong in (new.withColumn("observed_at_ms", new.id), new.withColumn("replaces_id", new.id), new.unionByName(new)):
        with pytest.raises(ValueError):
            store.replace_from_history(old, links, wrong)


def test_commits_are_numbered_and_never_change(spark, tmp_path):
    t = store.Commits(spark, str(tmp_path / "t"))
    assert t.last() is None
    for k in range(11):
        t.add(k, {"n": k})
    assert t.last() == {"n": 10, "seq": 10}
    with pytest.raises(RuntimeError):
        t.add(10, {"n": 99})
    assert t.last()["n"] == 10


def test_settings_are_held_in_their_ranges():
    c = Config(beam_width_deg=200, stationary_min_samples=1, history_resolution_s=500, display_depth="x", instrument_min_m=9, instrument_max_m=3, base_cell_m=-1, target_datum=" lat ", auto_backfill_days=99, max_zoom=30, surface_to_keel_m=float("nan"))
    assert (c.beam_width_deg, c.stationary_min_samples, c.history_resolution_s, c.display_depth, c.instrument_max_m, c.base_cell_m, c.target_datum, c.auto_backfill_days, c.max_zoom, c.surface_to_keel_m) == (90, 3, 60, "predicted", 120.0, 5.0, "LAT", 31, 24, 1.5)
    assert depth_reference("environment.depth.belowKeel") == "belowKeel"
    with pytest.raises(ValueError):
        depth_reference("environment.depth.other")


def test_hexagons_hold_their_centres():
    rng = random.Random(1)
    for _ in range(500):
        x, y = rng.uniform(-2e7, 2e7), rng.uniform(-2e7, 2e7)
        q, r = geo.cell_at(x, y, 7.0)
        cx, cy = 7.0 * (q + r / 2), 7.0 * math.sqrt(3) / 2 * r
        assert geo.cell_at(cx, cy, 7.0) == (q, r) and math.hypot(cx - x, cy - y) <= 7 / math.sqrt(3) + 1e-6
        near = [math.hypot(7.0 * (q + a + (r + b) / 2) - x, 7.0 * math.sqrt(3) / 2 * (r + b) - y) for a, b in geo.NEIGHBOURS]
        assert min(near) >= math.hypot(cx - x, cy - y) - 1e-6
    lo_x, hi_x, lo_y, hi_y = geo.cell_range((0, 0, 100, 100), 7.0)
    for _ in range(200):
        q, r = geo.cell_at(rng.uniform(0, 100), rng.uniform(0, 100), 7.0)
        assert lo_x <= q <= hi_x and lo_y <= r <= hi_y
