"""Cells from soundings: passes, depth clusters, the active one, change state, uncertainty and confidence.

Soundings have the columns that are used here, whatever others they have: id, observed_at_ms, cell_x, cell_y, tide_datum, pass_id, datum_depth_mm, vertical_sigma_mm, horizontal_sigma_mm, depth_source,
sample_count. A pass (one track of one day in one cell) is what ``pass_rows`` keeps of it: how many soundings
have each depth and each sigma, in millimetres, and a few totals. Such rows of one pass add up (``added``), and
cells are built from them alone, so a surface that keeps them needs no old sounding again. A cell's array holds
its passes with their counts of sigmas, never its soundings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.confidence import DAY_MS, evidence_cap, evidence_reasons, horizontal_cap, recency, valid_sigma
from leadline.functions.depth import conservative_m, water_depth_m
from leadline.functions.geo import hex_cell, hex_centre, hex_vertices, latitude_of, longitude_of, neighbour_cells
from leadline.functions.numbers import c, counted_median, counted_robust_sigma, median, metres, millimetres, robust_sigma, sorted_median, weighted_geometric_mean

CELL = ["cell_x", "cell_y", "datum"]
STATES = ["stable", "candidate_deepening", "suspected_shoaling", "confirmed"]


def active_soundings(soundings: DataFrame, replacements: DataFrame) -> DataFrame:
    """Soundings that no replacement (original_id) supersedes."""
    return soundings.join(replacements.select(F.col("original_id").alias("id")), "id", "left_anti")


PASS = [*CELL, "pass_id"]
_COUNTS = "array<struct<mm:bigint,n:bigint>>"


def pass_rows(soundings: DataFrame, config: Config) -> DataFrame:
    """What cells need of each pass: counts of depths and of sigmas (arrays of mm, n), the greatest horizontal_m, samples, sources, oldest_ms, newest_ms, n."""
    sigma_h = valid_sigma(metres("horizontal_sigma_mm"), config.position_sigma_m)
    # equal soundings are counted before they are shuffled by pass
    equal = soundings.withColumnRenamed("tide_datum", "datum").groupBy(*PASS, "datum_depth_mm", "vertical_sigma_mm").agg(
        F.count("*").alias("n"), F.max(sigma_h).alias("horizontal_m"), F.sum("sample_count").alias("samples"), F.collect_set("depth_source").alias("sources"), F.min("observed_at_ms").alias("oldest_ms"), F.max("observed_at_ms").alias("newest_ms"),
    )
    count = lambda name: F.filter(F.collect_list(F.struct(F.col(name).cast("long").alias("mm"), "n")), lambda v: v["mm"].isNotNull())
    return equal.groupBy(*PASS).agg(count("datum_depth_mm").alias("depths"), count("vertical_sigma_mm").alias("sigmas"), *_totals())


def _totals() -> list[Column]:
    return [
        F.max("horizontal_m").alias("horizontal_m"), F.sum("samples").cast("long").alias("samples"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.min("oldest_ms").alias("oldest_ms"), F.max("newest_ms").alias("newest_ms"), F.sum("n").alias("n"),
    ]


def added(passes: DataFrame) -> DataFrame:
    """Rows of ``pass_rows`` of several sets of soundings as those of all of them: one row for each pass, counts added."""

    def counts(name: str) -> Column:
        every = F.flatten(F.collect_list(name))
        values = F.array_sort(F.array_distinct(F.transform(every, lambda v: v["mm"])))
        sums = F.transform(values, lambda x: F.struct(x.alias("mm"), F.aggregate(F.filter(every, lambda v: v["mm"] == x), F.lit(0).cast("long"), lambda t, v: t + v["n"]).alias("n")))
        return F.when(F.size(values) < F.size(every), sums).otherwise(every).cast(_COUNTS).alias(name)

    return passes.groupBy(*PASS).agg(counts("depths"), counts("sigmas"), *_totals())


def estimated(passes: DataFrame) -> DataFrame:
    """Adds depth_m, the median, and within_m, the robust spread, of each pass."""
    depths = F.transform("depths", lambda v: F.struct(metres(v["mm"]).alias("x"), v["n"].alias("n")))
    out = passes.withColumn("_d", depths).withColumn("depth_m", counted_median(F.col("_d")))
    return out.withColumn("within_m", counted_robust_sigma(F.col("_d"), F.col("depth_m"))).drop("_d", "depths")


def pass_estimates(soundings: DataFrame, config: Config | None = None) -> DataFrame:
    """One row a pass and cell: median depth_m, robust within_m, oldest_ms, newest_ms, n."""
    return estimated(pass_rows(soundings, config or Config())).select(*PASS, "depth_m", "within_m", "oldest_ms", "newest_ms", "n")


def settled(value: Column) -> Column:
    """A value that is worked out once a row, whatever is filtered by it later.

    Spark moves a filter below what its columns are made of and puts their expressions in place of the names, each time
    anew where a name stands twice; of columns upon columns that grows as a power. What a generator gives stays above it.
    """
    return F.explode_outer(F.array(value))


def cluster_starts(depths: Column, threshold: float) -> Column:
    """Where clusters start in an ascending array of depths.

    A depth joins the cluster whose median is within the threshold. As depths come ascending, only the last
    cluster can take one, so a cluster is a run and its median the middle of the run so far.
    """
    def grow(state: Column, i: Column) -> Column:
        s = F.element_at(state, -1)
        centre = (F.get(depths, F.floor((s + i - 1) / 2).cast("int")) + F.get(depths, F.floor((s + i) / 2).cast("int"))) / F.lit(2.0)
        return F.when(F.abs(centre - F.get(depths, i)) <= threshold, state).otherwise(F.array_append(state, i))

    more = F.when(F.size(depths) > 1, F.sequence(F.lit(1), F.size(depths) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(more, F.array(F.lit(0)), grow)


def cell_clusters(passes: DataFrame, config: Config) -> DataFrame:
    """One row a cell: its clusters (array of k, centre_m, n, oldest_ms, newest_ms, passes), passes with all that is known of them."""
    item = F.struct("depth_m", "pass_id", *[c for c in passes.columns if c not in {*PASS, "depth_m"}])
    cells = passes.groupBy(*CELL).agg(F.array_sort(F.collect_list(item)).alias("passes"))
    # a column of its own, so that the fold doesn't make the array anew at each step
    cells = cells.withColumn("depths", F.transform("passes", lambda p: p["depth_m"])).withColumn("starts", cluster_starts(F.col("depths"), config.outlier_floor_m))

    def cluster(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("passes"))
        own = F.slice(F.col("passes"), s + 1, end - s)
        return F.struct(
            k.alias("k"),
            sorted_median(F.transform(own, lambda p: p["depth_m"])).alias("centre_m"),
            (end - s).alias("n"),
            F.array_min(F.transform(own, lambda p: p["oldest_ms"])).alias("oldest_ms"),
            F.array_max(F.transform(own, lambda p: p["newest_ms"])).alias("newest_ms"),
            own.alias("passes"),
        )

    return cells.select(*CELL, settled(F.transform("starts", cluster)).alias("clusters"))


def _first(xs: Column, *keys) -> Column:
    """The element that is least by keys, null of none."""
    return F.get(F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(*[k(x).alias(f"_{i}") for i, k in enumerate(keys)], x.alias("x")))), lambda p: p["x"]), F.lit(0))


def qualified(cluster: Column, config: Config) -> Column:
    return (cluster["n"] >= config.change_min_passes) & (cluster["newest_ms"] - cluster["oldest_ms"] >= config.change_min_days * DAY_MS)


def choose(cells: DataFrame, config: Config, previous: DataFrame | None = None) -> DataFrame:
    """Adds active, shallow and deep (clusters or null), before_m and change_state.

    Without a previous state the cluster of most passes is active, the newest of equals, then the shallowest.
    With one (robust_depth_mm by cell), the cluster nearest to it is, unless a qualified other is newer.
    """
    floor = config.outlier_floor_m
    if previous is None:
        cells = cells.withColumn("before_m", F.lit(None).cast("double"))
    else:
        cells = cells.join(previous.select(*CELL, metres("robust_depth_mm").alias("before_m")), CELL, "left")
    fresh = _first(F.col("clusters"), lambda x: -x["n"], lambda x: -x["newest_ms"], lambda x: x["k"])
    cells = cells.withColumn("base", _first(F.col("clusters"), lambda x: F.abs(x["centre_m"] - F.col("before_m")), lambda x: x["k"]))
    newer = F.filter("clusters", lambda x: (x["k"] != F.col("base.k")) & (x["newest_ms"] > F.col("base.newest_ms")) & qualified(x, config))
    cells = cells.withColumn("active", settled(F.when(F.col("before_m").isNull(), fresh).otherwise(F.coalesce(_first(newer, lambda x: -x["newest_ms"], lambda x: x["k"]), F.col("base")))))
    others = F.filter("clusters", lambda x: x["k"] != F.col("active.k"))
    cells = cells.withColumn("shallow", _first(F.filter(others, lambda x: x["centre_m"] < F.col("active.centre_m") - floor), lambda x: x["centre_m"], lambda x: x["k"]))
    deep = F.filter(others, lambda x: (x["newest_ms"] > F.col("active.newest_ms")) & (x["centre_m"] > F.col("active.centre_m") + floor))
    cells = cells.withColumn("deep", _first(deep, lambda x: -x["newest_ms"], lambda x: x["k"]))
    moved = F.coalesce(F.abs(F.col("active.centre_m") - F.col("before_m")) >= floor, F.lit(False))
    state = F.when(moved & qualified(F.col("active"), config), "confirmed").when(F.col("shallow").isNotNull(), "suspected_shoaling").when(F.col("deep").isNotNull(), "candidate_deepening").otherwise("stable")
    return cells.withColumn("change_state", state).drop("base")


def _parts(chosen: DataFrame) -> DataFrame:
    """Each pass of each cell: whether it is of the active cluster, and of the one that controls uncertainty."""
    # made in one piece: explode upon explode has the clusters worked out again for each of them
    members = F.flatten(F.transform("clusters", lambda c: F.transform(c["passes"], lambda p: F.struct(p["pass_id"].alias("pass_id"), c["k"].alias("k")))))
    p = chosen.select(*CELL, F.col("active.k").alias("_a"), F.coalesce("shallow.k", "active.k").alias("_u"), F.explode(members).alias("m"))
    return p.select(*CELL, (F.col("m.k") == F.col("_a")).alias("is_active"), (F.col("m.k") == F.col("_u")).alias("is_uncertain"), "m.pass_id")


def pass_states(passes: DataFrame, config: Config, previous: DataFrame | None = None) -> DataFrame:
    """QC of each pass, which all its soundings share: cell, pass_id, is_active."""
    return _parts(choose(cell_clusters(estimated(passes), config), config, previous)).select(*PASS, "is_active")


def classified(soundings: DataFrame, states: DataFrame) -> DataFrame:
    """QC of each sounding from that of its pass: sounding_id, qc_state (accepted or quarantined), reasons array."""
    rows = soundings.withColumnRenamed("tide_datum", "datum").join(states, PASS)
    return rows.select(F.col("id").alias("sounding_id"), F.when(F.col("is_active"), "accepted").otherwise("quarantined").alias("qc_state"), F.when(F.col("is_active"), F.array().cast("array<string>")).otherwise(F.array(F.lit("local_depth_cluster_disagreement"))).alias("reasons"))


def classify(soundings: DataFrame, config: Config, previous: DataFrame | None = None) -> DataFrame:
    """QC of each sounding: sounding_id, qc_state (accepted or quarantined), reasons array."""
    return classified(soundings, pass_states(pass_rows(soundings, config), config, previous))


def build_cells(soundings: DataFrame, config: Config, previous: DataFrame | None = None, updated_at_ms: int = 0) -> DataFrame:
    """Every cell of the soundings, as stored: depths and sigmas in mm, counts, times, change state, base confidence."""
    return cells_of_passes(pass_rows(soundings, config), config, previous, updated_at_ms)


def cells_of_passes(passes: DataFrame, config: Config, previous: DataFrame | None = None, updated_at_ms: int = 0) -> DataFrame:
    """Every cell of the passes (``pass_rows``, one row for each), as ``build_cells`` gives them."""
    chosen = choose(cell_clusters(estimated(passes), config), config, previous).withColumn("held", F.coalesce("shallow", "active"))
    of = lambda cluster, name: F.transform(f"{cluster}.passes", lambda p: p[name])
    total = lambda name: F.aggregate(of("active", name), F.lit(0).cast("long"), lambda t, n: t + n)
    sigmas = F.transform(F.flatten(of("held", "sigmas")), lambda v: F.struct(metres(v["mm"]).alias("x"), v["n"].alias("n")))
    cells = chosen.select(
        *CELL, "change_state", "before_m",
        F.col("active.centre_m").alias("robust_m"), F.col("held.centre_m").alias("render_m"),
        F.col("active.n").cast("long").alias("pass_count"), F.greatest(F.lit(1), F.col("held.n")).alias("independent"),
        robust_sigma(of("held", "depth_m")).alias("repeat_m"), median(of("held", "within_m")).alias("visit_m"),
        counted_median(sigmas).alias("measured_m"), F.array_max(of("held", "horizontal_m")).alias("horizontal_m"),
        total("n").alias("observation_count"), total("samples").alias("sounding_count"), F.size(F.array_distinct(F.flatten(of("active", "sources")))).cast("long").alias("source_count"),
        F.col("active.oldest_ms").alias("oldest_at_ms"), F.col("active.newest_ms").alias("newest_at_ms"),
    )
    sigma = F.sqrt(F.col("measured_m") * F.col("measured_m") + F.col("repeat_m") * F.col("repeat_m") / F.col("independent") + F.col("visit_m") * F.col("visit_m") / F.col("independent"))
    cells = cells.withColumn("sigma_m", sigma)
    latitude = latitude_of(hex_centre("cell_x", "cell_y", config.base_cell_m)[1])
    evidence = weighted_geometric_mean([
        (F.exp(-F.col("measured_m")), 2),
        (F.lit(1.0) - F.exp(-F.col("observation_count") / 4), 1),
        (F.lit(0.45) + F.lit(0.55) * F.least(F.lit(1.0), F.col("pass_count") / 3), 2),
        (F.exp(-F.col("repeat_m") / 0.5), 2),
        (F.exp(-F.col("visit_m") / 0.5), 1),
        (F.when(F.col("source_count") >= 2, F.lit(1.0)).otherwise(F.lit(0.7)), 1),
    ])
    base = F.least(horizontal_cap("horizontal_m", latitude, config.base_cell_m), evidence, evidence_cap("observation_count", "pass_count", "source_count"))
    return cells.select(
        *CELL,
        millimetres("robust_m").alias("robust_depth_mm"),
        millimetres("render_m").alias("render_depth_mm"),
        millimetres(conservative_m("render_m", "sigma_m")).alias("conservative_depth_mm"),
        F.greatest(F.lit(1).cast("long"), millimetres("sigma_m")).alias("vertical_sigma_mm"),
        millimetres("horizontal_m").alias("horizontal_sigma_mm"),
        base.alias("confidence_base"),
        "sounding_count", "observation_count", "pass_count", "source_count", "oldest_at_ms", "newest_at_ms", "change_state",
        millimetres("before_m").alias("previous_depth_mm"),
        F.lit(updated_at_ms).cast("long").alias("updated_at_ms"),
    )


def history_of(cells: DataFrame) -> DataFrame:
    """Confirmed changes among freshly built cells."""
    return cells.filter("change_state = 'confirmed'").select(*CELL, "previous_depth_mm", F.col("robust_depth_mm").alias("new_depth_mm"), F.col("updated_at_ms").alias("changed_at_ms"))


def read_cells(cells: DataFrame, config: Config, as_of_ms: int) -> DataFrame:
    """Stored cells as they are shown at a time: metres, confidence less its age, reasons."""
    latitude = latitude_of(hex_centre("cell_x", "cell_y", config.base_cell_m)[1])
    sigma_h = valid_sigma(metres("horizontal_sigma_mm"), config.position_sigma_m)
    wide = F.lit(2.0) * F.col("horizontal_sigma_m") > F.lit(config.base_cell_m) * F.cos(F.radians(latitude))
    out = cells.withColumn("horizontal_sigma_m", sigma_h)
    reasons = F.concat(evidence_reasons("observation_count", "pass_count", "source_count"), F.when(wide, F.array(F.lit("horizontal_uncertainty_exceeds_cell"))).otherwise(F.array().cast("array<string>")))
    return out.select(
        *CELL,
        metres("robust_depth_mm").alias("robust_m"), metres("render_depth_mm").alias("render_m"), metres("conservative_depth_mm").alias("conservative_m"),
        metres("vertical_sigma_mm").alias("vertical_sigma_m"), "horizontal_sigma_m",
        F.least(F.lit(1.0), F.col("confidence_base") * recency("newest_at_ms", as_of_ms, config.recency_half_life_days)).alias("confidence"),
        reasons.alias("reasons"), "sounding_count", "observation_count", "pass_count", "source_count", "oldest_at_ms", "newest_at_ms", "change_state", "updated_at_ms",
    )


def neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of adjacent cells of one datum: cell_x, cell_y, datum, neighbour_x, neighbour_y."""
    around = cells.select(*CELL, F.explode(neighbour_cells("cell_x", "cell_y")).alias("n")).select(*CELL, F.col("n.x").alias("neighbour_x"), F.col("n.y").alias("neighbour_y"))
    there = cells.select(F.col("cell_x").alias("neighbour_x"), F.col("cell_y").alias("neighbour_y"), "datum")
    return around.join(there, ["neighbour_x", "neighbour_y", "datum"]).select(*CELL, "neighbour_x", "neighbour_y")


def with_neighbours(cells: DataFrame, config: Config) -> DataFrame:
    """Shown cells with neighbour_support, neighbour_delta_m, and weak ones held down where strong neighbours disagree.

    Strong: 3 observations, 2 passes and a confidence of 0.55 at least. All cells count, whatever is shown of them.
    """
    strong = (F.col("observation_count") >= 3) & (F.col("pass_count") >= 2) & (F.col("confidence") >= 0.55)
    # each cell goes to its own key, a strong one's depth to its six neighbours' as well: one pass, no self-join
    own = F.struct(F.col("cell_x").alias("x"), F.col("cell_y").alias("y"))
    to = F.concat(F.array(own), F.when(strong, neighbour_cells("cell_x", "cell_y")).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>")))
    sent = cells.select("datum", F.struct(*cells.columns).alias("cell"), F.posexplode(to).alias("n", "to"))
    here = sent.groupBy(F.col("to.x").alias("to_x"), F.col("to.y").alias("to_y"), F.col("datum").alias("to_datum"))
    # six values at most
    out = here.agg(F.first(F.when(F.col("n") == 0, F.col("cell")), ignorenulls=True).alias("cell"), F.collect_list(F.when(F.col("n") > 0, F.col("cell.robust_m"))).alias("around"))
    out = out.filter("cell is not null").select("cell.*", "around").withColumn("support", F.size("around"))
    weak = (F.col("support") >= 2) & ((F.col("observation_count") <= 2) | (F.col("pass_count") <= 1))
    delta = F.when(weak, F.abs(F.col("robust_m") - median("around")))
    tolerance = F.greatest(F.lit(1.5 * config.outlier_floor_m), F.lit(1.5) * robust_sigma("around"))
    differs = F.coalesce(delta > tolerance, F.lit(False))
    cap = F.when(F.col("observation_count") <= 1, F.lit(0.12)).when(F.col("observation_count") <= 2, F.lit(0.22)).otherwise(F.lit(0.3))
    return out.withColumns({
        "neighbour_support": F.col("support").cast("long"),
        "neighbour_delta_m": delta,
        "confidence": F.when(differs, F.least("confidence", cap)).otherwise(F.col("confidence")),
        "reasons": F.when(differs, F.array_append("reasons", F.lit("neighbor_depth_disagreement"))).otherwise(F.col("reasons")),
    }).drop("around", "support")


def _placed(cells: DataFrame, base_m: float, widths: list[float]) -> DataFrame:
    """Each cell once for each width, with the wider cell that its centre is in (width_m, px, py) and how many cells fill that."""
    x, y = hex_centre("cell_x", "cell_y", base_m)

    def parent(w: float) -> Column:
        px, py = hex_cell(x, y, w)
        return F.struct(F.lit(float(w)).alias("width_m"), px.alias("px"), py.alias("py"), F.lit((w / base_m) ** 2).alias("whole"))

    return cells.withColumn("_at", F.explode(F.array(*map(parent, widths)))).select("*", "_at.*").drop("_at")


def _rolled_up(placed: DataFrame, tide: tuple[float, float] | None) -> DataFrame:
    """One row for each width, wider cell and datum. All of it merges, so cells are rolled up before they are shuffled."""
    depth = F.col("conservative_m") if tide is None else water_depth_m("render_m", "vertical_sigma_m", *tide)
    member = F.struct(depth.alias("d"), "cell_x", "cell_y", "robust_m", "render_m", "conservative_m", "vertical_sigma_m", "horizontal_sigma_m", "confidence", "newest_at_ms", F.array_join("reasons", "|").alias("reasons"))
    g = placed.withColumn("_m", member).groupBy("width_m", "whole", "px", "py", "datum").agg(
        F.min("_m").alias("m"), F.count("*").alias("members"),
        F.sum("sounding_count").alias("sounding_count"), F.sum("observation_count").alias("observation_count"),
        F.max("pass_count").alias("pass_count"), F.max("source_count").alias("source_count"),
        F.min("oldest_at_ms").alias("oldest_at_ms"), F.max("updated_at_ms").alias("updated_at_ms"), F.max(state_rank("change_state")).alias("rank"),
    )
    return g.select(
        "width_m", F.col("px").alias("cell_x"), F.col("py").alias("cell_y"), "datum", "m.robust_m", "m.render_m", "m.conservative_m", "m.vertical_sigma_m", "m.horizontal_sigma_m", "m.confidence",
        F.split("m.reasons", r"\|").alias("reasons"), F.least(F.lit(1.0), F.col("members") / F.col("whole")).alias("coverage"),
        "sounding_count", "observation_count", "pass_count", "source_count", "oldest_at_ms", "m.newest_at_ms", rank_state("rank").alias("change_state"), "updated_at_ms",
    )


def overview(cells: DataFrame, base_m: float, display_m: float, tide: tuple[float, float] | None = None) -> DataFrame:
    """Shown cells rolled up to wider ones: the shallowest member controls, the first by cell of equals.

    ``tide`` (height, sigma) makes depths of water decide. Depths, sigma, confidence, reasons and newest time are
    the controlling member's; counts are summed or maxed; coverage is the share of base cells there is evidence in.
    """
    return cells if display_m <= base_m else pyramid(cells, base_m, [display_m], tide).drop("width_m")


def pyramid(cells: DataFrame, base_m: float, widths: list[float], tide: tuple[float, float] | None = None) -> DataFrame:
    """The overviews of all widths over the base, with their ``width_m``, from one pass over the shown cells.

    Hexagons of one width don't fill those of the next, so each level takes base cells, by their centres; what a task has of a
    wider cell is rolled up before the one shuffle.
    """
    return _rolled_up(_placed(cells, base_m, [w for w in widths if w > base_m]), tide)


def parents(cells: DataFrame, base_m: float, widths: list[float]) -> DataFrame:
    """The display cells (width_m, cell_x, cell_y, datum) of all widths that cells (cell_x, cell_y, datum) are in; at the base's width themselves."""
    return _placed(cells.select(*CELL), base_m, widths).select("width_m", F.col("px").alias("cell_x"), F.col("py").alias("cell_y"), "datum").distinct()


def updated_pyramid(stored: DataFrame, cells: DataFrame, touched: DataFrame, base_m: float, widths: list[float], tide: tuple[float, float] | None = None) -> DataFrame:
    """A pyramid after some cells (cell_x, cell_y, datum) were built anew, came or went: only the wider cells that they are in are rolled up again."""
    widths, keys = [w for w in widths if w > base_m], ["width_m", "px", "py", "datum"]
    parents = _placed(touched.select(*CELL), base_m, widths).select(*keys).distinct()
    fresh = _rolled_up(_placed(cells, base_m, widths).join(parents, keys, "left_semi"), tide)
    gone = parents.select("width_m", F.col("px").alias("cell_x"), F.col("py").alias("cell_y"), "datum")
    return stored.join(gone, ["width_m", *CELL], "left_anti").unionByName(fresh)


def state_rank(state) -> Column:
    """Place of a state by precedence, 1 to 4."""
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), c(state))


def rank_state(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), c(rank).cast("int"))


def polygon(cell_x, cell_y, width_m: float) -> Column:
    """A cell's closed ring as an array of [longitude, latitude]."""
    ring = F.transform(hex_vertices(cell_x, cell_y, width_m), lambda v: F.array(longitude_of(v["x"]), latitude_of(v["y"])))
    return F.concat(ring, F.slice(ring, 1, 1))
