"""An order of positions along a space-filling curve: a box becomes few ranges of one key, which prune files and row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.functions.numbers import ColumnOrName, c
from leadline.operators.listing import PLACE, Bbox, box_e7, in_bbox

#: Each axis has so many bits in the key.
BITS = 31
# The shifts and masks that put a blank bit after each of 31 bits.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
#: A box is covered by at most so many ranges.
MOST_RANGES = 24


def _axes(lat_e7, lon_e7) -> tuple:
    """Both axes from 0 on: half units of longitude, units of latitude."""
    return (lon_e7 + 1_800_000_000) / 2, lat_e7 + 900_000_000


def place(lat: ColumnOrName = "lat_e7", lon: ColumnOrName = "lon_e7") -> Column:
    """A position's key: its bits of longitude and latitude by turns. Positions off the globe are held at its edge, null stays null."""

    def bits(v: Column) -> Column:
        v = F.when(v < 0, F.lit(0)).when(v >= 2**BITS, F.lit(2**BITS - 1)).otherwise(F.floor(v)).cast("long")
        for by, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    x, y = _axes(c(lat).cast("long"), c(lon).cast("long"))
    return F.when(c(lat).isNotNull() & c(lon).isNotNull(), bits(x).bitwiseOR(F.shiftleft(bits(y), 1)))


def cover(bbox: Bbox, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that hold all of (west, south, east, north), and as little else as so few ranges can.

    Squares of the curve are quartered, the widest first, while there may be more of them; what touches is joined.
    """
    w, s, e, n = box_e7(bbox)
    if w > e or s > n:
        return []
    held = lambda v: min(max(int(v // 1), 0), 2**BITS - 1)
    (x0, y0), (x1, y1) = (tuple(map(held, _axes(*p))) for p in ((s, w), (n, e)))
    # squares by (first key, bits of the side, corner), all that meet the box; whole ones need no quartering
    open_, whole = [(0, BITS, 0, 0)], []
    while open_:
        widest = max(open_, key=lambda q: q[1])
        key, bits, x, y = widest
        half = bits - 1
        quarters = [(key + (i << 2 * half), half, x + ((i & 1) << half), y + ((i >> 1) << half)) for i in range(4)] if bits else []
        meet = [q for q in quarters if q[2] <= x1 and q[2] + (1 << half) > x0 and q[3] <= y1 and q[3] + (1 << half) > y0]
        if not bits or len(open_) + len(whole) - 1 + len(meet) > most:
            break
        open_.remove(widest)
        for q in meet:
            inside = q[2] >= x0 and q[2] + (1 << half) - 1 <= x1 and q[3] >= y0 and q[3] + (1 << half) - 1 <= y1
            (whole if inside else open_).append(q)
    out: list[tuple[int, int]] = []
    for key, bits, _, _ in sorted(open_ + whole):
        low, high = key, key + (1 << 2 * bits) - 1
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def within(rows: DataFrame, bbox: Bbox, most: int = MOST_RANGES) -> DataFrame:
    """Rows of a box; where they have a key (``with_place``), its ranges are pushed down and the exact test follows."""
    if PLACE not in rows.columns:
        return rows.filter(in_bbox(bbox))
    near = F.lit(False)
    for low, high in cover(bbox, most):
        near = near | F.col(PLACE).between(low, high)
    return rows.filter(near & in_bbox(bbox))


def with_place(rows: DataFrame) -> DataFrame:
    """Rows with their key; a column of its name is replaced."""
    return rows.withColumn(PLACE, place())


def write_by_place(rows: DataFrame, path: str, files: int, mode: str = "error") -> None:
    """Writes rows as so many Parquet files by ranges of their key, sorted inside: one shuffle, and a spot that holds most rows takes as
    many files as it needs, since ties go by time. A file's and a row group's least and greatest key then say where it lies."""
    keyed = with_place(rows)
    order = [PLACE, *[n for n in ("observed_at_ms", "id") if n in rows.columns]]
    keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode(mode).parquet(path)
