"""Views of the driver's tables in the shapes of the engine: soundings, time series, crowdsourced points, a raw journal.

Each is a text of SQL with the two ways in which Spark and DuckDB differ left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.functions.geo import hex_cell, mercator_x, mercator_y

_POSITION = """cast(378000000 + (event_id % 25) * 450 as bigint) as lat_e7,
 cast(-1224000000 + (cast(floor(event_id / 25) as bigint) % 40) * 570 as bigint) as lon_e7"""

SOUNDINGS = f"""select event_id as id, {{us_ts}} {{div}} 1000 as observed_at_ms, {_POSITION},
 cast(4000 + (event_id % 25) * 40
   + case when user_id % 23 = 0 then -1200 when user_id % 23 = 1 then 1300 else 0 end
   + case when (event_id % 1000) % 10 = 0 and {{us_ts}} >= 1705708800000000 then -1500 else 0 end
   + (cast(floor(value * 100) as bigint) % 40) * 10 as bigint) as datum_depth_mm,
 cast(150 + event_id % 200 as bigint) as vertical_sigma_mm,
 case when event_id % 13 = 0 then null else cast(1000 + (event_id % 5) * 500 as bigint) end as horizontal_sigma_mm,
 concat(cast(cast(ts as date) as {{text}}), ':', cast(user_id as {{text}})) as pass_id,
 event_type as depth_source, 'MLLW' as tide_datum, cast(1 as bigint) as sample_count, cast(event_id % 3 as bigint) as rejected_sample_count,
 cast(user_id as bigint) as track, case event_id % 4 when 0 then 'exact' when 1 then 'interpolated' when 2 then 'history_unaligned' else 'legacy_unaligned' end as position_method,
 case event_id % 3 when 0 then 'belowKeel' when 1 then 'belowSurface' else 'belowTransducer' end as depth_reference,
 cast(1000 + event_id % 700 as bigint) as tide_height_mm, cast(event_id % 1500 as bigint) as input_time_skew_ms
from events"""

SERIES = f"""select user_id % 5 as context, event_id, {{us_ts}} {{div}} 1000 as at_ms,
 case event_type when 'click' then 'depth' when 'view' then 'position' when 'purchase' then 'tide' when 'signup' then 'sog' else 'heading' end as path,
 case event_type when 'click' then 400 + cast(floor(value * 100) as bigint) % 20000
   when 'purchase' then 1000 + cast(floor(value * 100) as bigint) % 50
   when 'signup' then cast(floor(value * 100) as bigint) % 5000
   when 'error' then cast(floor(value * 100) as bigint) % 360000 end as v_milli, {_POSITION}
from events"""

CROWD = """select concat('V', cast(l_suppkey as {text})) as unique_id, concat('F', cast(l_orderkey % 50 as {text})) as file_uuid,
 {us_ship} {div} 1000 as observed_at_ms,
 cast(378000000 + (l_partkey % 1000) * 450 as bigint) as lat_e7, cast(-1224000000 + (l_partkey % 997) * 570 as bigint) as lon_e7,
 case when l_linenumber = 7 then -1000000000 else cast(l_quantity * 1000 as bigint) end as depth_mm,
 s_name as platform, case when l_returnflag = 'N' then '' else l_returnflag end as provider, l_linestatus as instrument
from lineitem join supplier on l_suppkey = s_suppkey"""

JOURNAL = f"""select event_id as seq, {{us_ts}} {{div}} 1000 as observed_at_ms, {{us_ts}} {{div}} 1000 + copy * 500 as received_at_ms,
 400 + cast(floor(value * 100) as bigint) % 20000 as depth_mm, event_type as depth_source, {_POSITION}, event_id % 9 <> 0 as has_position,
 case when event_id % 7 = 0 then null else 1000 + cast(floor(value * 100) as bigint) % 50 end as tide_mm, event_id % 5 = 0 as tide_stale,
 case when event_id % 11 = 0 then 'stale-position' end as quality, cast(1500 as bigint) as surface_offset_mm
from events cross join (select 0 as copy union all select 1 as copy) copies where copy = 0 or event_id % 20 = 0"""


def spark_sql(template: str) -> str:
    us = "unix_micros(cast(cast({} as timestamp) as timestamp))"
    return template.format(us_ts=us.format("ts"), us_ship=us.format("l_shipdate"), div="div", text="string")


def duck_sql(template: str) -> str:
    return template.format(us_ts="epoch_us(cast(ts as timestamp))", us_ship="epoch_us(cast(l_shipdate as timestamp))", div="//", text="varchar")


def _view(spark: SparkSession, sf_dir: str, template: str, *tables: str) -> DataFrame:
    text = spark_sql(template)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **frames)


def soundings(spark: SparkSession, sf_dir: str, cell_m: float = 5.0) -> DataFrame:
    s = _view(spark, sf_dir, SOUNDINGS, "events")
    x, y = hex_cell(mercator_x(F.col("lon_e7") / 1e7), mercator_y(F.col("lat_e7") / 1e7), cell_m)
    return s.withColumns({"cell_x": x, "cell_y": y})


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SERIES, "events")


def crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CROWD, "lineitem", "supplier")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, JOURNAL, "events")
