"""Ranges of an order, of about as many rows each, for numbers that go through a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a range on average, and the most ranges there are, on average too.
RANGE_ROWS, MOST_RANGES = 65_536, 1 << 16


def edges_of(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """One row with the sorted edges of ranges: rows taken evenly by a hash of the columns of the order."""
    apart = max(RANGE_ROWS, -(-n // MOST_RANGES))
    taken = rows.filter(F.pmod(F.xxhash64(F.lit("edge"), *order), F.lit(apart)) == 0).select(F.struct(*order).alias("key")).distinct()
    return taken.agg(F.array_sort(F.collect_list("key")).alias("_edges"))


def in_ranges(rows: DataFrame, order: list[str], edges: DataFrame, name: str = "_range") -> DataFrame:
    """The rows with the number of edges up to them, found by halving; the edges are one value that goes to every task."""
    halves = F.array(*[F.lit(1 << k) for k in range(MOST_RANGES.bit_length() + 1, -1, -1)])
    at = F.aggregate(halves, F.lit(0), lambda i, half: F.when(F.get("_edges", i + half - 1) <= F.struct(*order), i + half).otherwise(i))
    return rows.withColumn("_edges", edges.scalar()).withColumn(name, at).drop("_edges")


def numbered(rows: DataFrame, order: list[str], last: int = 0, name: str = "id") -> DataFrame:
    """Consecutive numbers by an order (nulls first), after ``last``: each range counts apart, so no task holds all rows."""
    n = rows.count()
    dealt = in_ranges(rows, order, edges_of(rows, order, n))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # at most a row for each range
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_rank", rank).join(F.broadcast(counts.withColumn("_earlier", earlier)), "_range").withColumn(name, F.col("_rank") + F.col("_earlier") + last).drop("_range", "_rank", "_n", "_earlier")
