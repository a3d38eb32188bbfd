"""Delta messages: nested updates into rows of (context, path, source, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SOURCE = T.StructType([T.StructField("label", T.StringType()), T.StructField("src", T.StringType()), T.StructField("type", T.StringType())])
_VALUE = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("state", T.StructType([T.StructField("timedOut", T.BooleanType())]))])
_UPDATE = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("$source", T.StringType()), T.StructField("source", _SOURCE), T.StructField("values", T.ArrayType(_VALUE))])
#: A delta message; values stay JSON text, as their shape depends on the path.
DELTA = T.StructType([T.StructField("context", T.StringType()), T.StructField("updates", T.ArrayType(_UPDATE))])


def flatten(messages: DataFrame, received_ms: Column | None = None) -> DataFrame:
    """One row a value: context, path, source, at_ms, value (JSON text), has_time. Works on streams as well.

    Updates without values and values that timed out are skipped. The source is ``$source``, else the label, source
    or type of the old form, else unknown. A time that is missing or can't be read is the time of receipt.
    """
    u = messages.select("context", F.explode("updates").alias("u")).filter(F.size(F.coalesce("u.values", F.array().cast(_UPDATE["values"].dataType))) > 0)
    v = u.select("context", "u", F.explode("u.values").alias("v")).filter(~F.coalesce("v.state.timedOut", F.lit(False)))
    filled = lambda x: F.nullif(x, F.lit(""))
    source = F.coalesce(filled(F.col("u.`$source`")), filled(F.col("u.source.label")), filled(F.col("u.source.src")), filled(F.col("u.source.type")), F.lit("unknown"))
    now = F.unix_millis(F.current_timestamp()) if received_ms is None else received_ms
    read = F.unix_millis(F.try_to_timestamp(F.col("u.timestamp")))
    return v.select(F.coalesce("context", F.lit("vessels.self")).alias("context"), "v.path", source.alias("source"), F.coalesce(read, now).alias("at_ms"), "v.value", read.isNotNull().alias("has_time"))


def read(spark, path: str) -> DataFrame:
    """Delta messages from JSON lines; values of any shape become their text."""
    return spark.read.schema(DELTA).json(path)


def stream(spark, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(DELTA).option("maxFilesPerTrigger", files_per_batch).json(path)


def position(value: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of a value: an object with both, or [longitude, latitude]; null unless finite and on the globe."""
    number = lambda path: F.get_json_object(value, path).try_cast("double")
    lat, lon = F.coalesce(number("$.latitude"), number("$[1]")), F.coalesce(number("$.longitude"), number("$[0]"))
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, lat), F.when(good, lon)


def resample(rows: DataFrame, by: list[str], bucket_ms: int, how: str = "first") -> DataFrame:
    """One value a bucket of time and key, as history providers give: the first, or the mean of numbers.

    A mean is the sum from the least number to the greatest over their count, so the order in which rows come doesn't tell.
    For that a bucket's numbers are gathered.
    """
    mean = F.aggregate(F.sort_array(F.collect_list("value")), F.lit(0.0), lambda t, x: t + x) / F.nullif(F.count("value"), F.lit(0))
    b = rows.withColumn("bucket_ms", F.floor(F.col("at_ms") / bucket_ms) * bucket_ms).groupBy(*by, "bucket_ms")
    return b.agg((F.min_by("value", "at_ms") if how == "first" else mean).alias("value")).withColumnRenamed("bucket_ms", "at_ms")


_COLUMN = T.StructType([T.StructField("path", T.StringType()), T.StructField("method", T.StringType())])
#: A history provider's response; rows are a time and a value for each path, as text.
RESPONSE = T.StructType([T.StructField("context", T.StringType()), T.StructField("values", T.ArrayType(_COLUMN)), T.StructField("data", T.ArrayType(T.ArrayType(T.StringType())))])


def history_series(responses: DataFrame, path: str, is_position: bool = False, method: str | None = None) -> DataFrame:
    """One path's series (context, at_ms, and value or latitude, longitude) of responses; rows without a readable time or a usable value are left out.

    ``method`` is the aggregation that was asked for: a response that used another one is an error.
    """
    at = F.array_position(F.transform("values", lambda v: v["path"]), path)
    used = F.element_at(F.transform("values", lambda v: v["method"]), F.when(at > 0, at.cast("int")))
    given = responses.filter(at > 0)
    if method is not None:
        wrong = F.raise_error(F.format_string(f"the provider used %s and not {method} for {path}", F.coalesce(used, F.lit("nothing")))).cast("long")
        at = F.when(F.coalesce(used, F.lit(method)) != method, wrong).otherwise(at)
    rows = given.select("context", at.cast("int").alias("at"), F.explode("data").alias("row")).select("context", F.unix_millis(F.try_to_timestamp(F.get("row", F.lit(0)))).alias("at_ms"), F.get("row", F.col("at")).alias("value"))
    if is_position:
        lat, lon = position(F.col("value"))
        return rows.select("context", "at_ms", lat.alias("latitude"), lon.alias("longitude")).filter("at_ms is not null and latitude is not null and longitude is not null")
    number = F.col("value").try_cast("double")
    return rows.select("context", "at_ms", F.when(F.abs(number) < float("inf"), number).alias("value")).filter("at_ms is not null and value is not null")
