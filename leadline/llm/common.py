"""What the training-data operators share: input columns, batches, shared storage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 256
#: Spark's own, which is left where the user hasn't set another.
SPARK_BATCH_ROWS = "10000"


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with short Arrow batches so that a batch of long texts stays small.

    Spark takes the length from the session when a query runs. One that the user has set, other than Spark's own,
    is left alone.
    """
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == SPARK_BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others, whatever they are called, can't clash."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of a table; a null text is an empty one."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str = "doc_id") -> str:
    return df.schema[id_col].dataType.simpleString()


def fold_of(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % folds


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; where it is unset, one in the warehouse.

    Only a local master, all of whose tasks are on this machine, gets a temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        there = sc._jsc.sc().getCheckpointDir()
        base = there.get() if there.isDefined() else None
    if not base and re.fullmatch(r"local(\[.*\])?", sc.master):
        base = _local_dir()
    return base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/leadline-scratch"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="leadline-")


#: Folders that ``written`` made and that are still there.
_made: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: lineage ends there and lost executors cost nothing.

    The table goes at the end of the enclosing ``scratch``, or when Python ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/leadline-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    _made[folder] = spark
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._folder = folder
    return out


def drop(*frames: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing reads any more."""
    for f in frames:
        _remove(f._folder)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, all tables written within it but those given to the function that it yields."""
    before, keep = {*_made}, set()

    def spare(df: DataFrame) -> DataFrame:
        keep.add(df._folder)
        return df

    yield spare
    for folder in [*_made]:
        if folder not in before and folder not in keep:
            _remove(folder)


def _remove(folder: str) -> None:
    spark = _made.pop(folder, None)
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before
        pass


@atexit.register
def _remove_all() -> None:
    for folder in [*_made]:
        _remove(folder)
