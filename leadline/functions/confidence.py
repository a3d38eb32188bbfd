"""Confidence of a cell from its evidence, its age and its position, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions.numbers import ColumnOrName, c

DAY_MS = 86_400_000


def recency(newest_ms: ColumnOrName, as_of_ms: int, half_life_days: float) -> Column:
    """Halves with each half-life since the newest evidence; the future counts as now."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of_ms) - c(newest_ms)) / F.lit(float(DAY_MS)))
    return F.pow(F.lit(2.0), -age / F.lit(float(half_life_days)))


# The most confidence that so few observations, passes and sources allow.
OBSERVATION_CAPS = {1: 0.25, 2: 0.4}
PASS_CAPS = {1: 0.35, 2: 0.6}
SOURCE_CAP = 0.75


def _cap(count: Column, caps: dict[int, float]) -> Column:
    out = F.when(count <= 1, F.lit(caps[1]))
    return out.when(count == 2, F.lit(caps[2])).otherwise(F.lit(1.0))


def evidence_cap(observations: ColumnOrName, passes: ColumnOrName, sources: ColumnOrName) -> Column:
    return F.least(_cap(c(observations), OBSERVATION_CAPS), _cap(c(passes), PASS_CAPS), F.when(c(sources) <= 1, F.lit(SOURCE_CAP)).otherwise(F.lit(1.0)))


def evidence_reasons(observations: ColumnOrName, passes: ColumnOrName, sources: ColumnOrName) -> Column:
    """What there is too little of, as an array of names."""
    o, p, s = c(observations), c(passes), c(sources)
    said = [
        F.when(o <= 1, F.lit("single_observation")).when(o == 2, F.lit("only_two_observations")),
        F.when(p <= 1, F.lit("single_pass")).when(p == 2, F.lit("only_two_passes")),
        F.when(s <= 1, F.lit("single_source")),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def horizontal_cap(sigma_m: ColumnOrName, latitude: ColumnOrName, cell_m: float) -> Column:
    """Share of a position's spread that the cell, as wide as it is on the ground, holds."""
    ground = F.lit(float(cell_m)) * F.cos(F.radians(c(latitude)))
    return F.least(F.lit(1.0), F.pow(ground / (F.lit(2.0) * c(sigma_m)), F.lit(2.0)))


def valid_sigma(sigma_m: ColumnOrName, fallback: float) -> Column:
    x = c(sigma_m)
    return F.coalesce(F.when((x > 0) & (x < float("inf")), x), F.lit(float(fallback)))
