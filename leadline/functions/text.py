"""JSON text that may be broken, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions.numbers import ColumnOrName, c


def json_array(text: ColumnOrName) -> Column:
    """The elements of a JSON array as text; an empty array for null, broken text and anything else."""
    # a lone value would count as an array of one
    is_array = F.ltrim(c(text)).startswith("[")
    return F.coalesce(F.when(is_array, F.from_json(c(text), "array<string>")), F.array().cast("array<string>"))


def json_at(text: ColumnOrName, path: str) -> Column:
    """What a dotted path leads to in a JSON object, as text; null where it leads nowhere."""
    return F.get_json_object(c(text), "$" + "".join(f"['{p}']" for p in path.split(".")))
