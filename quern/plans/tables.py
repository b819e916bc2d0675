"""Tables in the folder that all executors share, and joins that hot keys do not stall.

``written`` cuts lineage and survives lost executors; ``split_join`` parts hot keys from the others.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of this session that were not dropped yet.
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where a local master leaves it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "quern-shared")
    return base.rstrip("/")


def named_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``drop_all`` deletes what is written there."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with these options of the writer, and read it back.

    It cuts lineage and survives lost executors; unlike an eager checkpoint
    the rows are computed only once.
    """
    spark = df.sparkSession
    path = named_path(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _paths:
        _paths.remove(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` once nothing reads it any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables this session has left in the shared folder; for when all results have been read."""
    for path in list(_paths):
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end the tables written meanwhile, but for those given to what it yields; for when nothing reads the others any more."""
    before, kept = set(_paths), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quern_path)
        return df

    yield keep
    for path in [p for p in _paths if p not in before | kept]:
        _delete(spark, path)


#: Keys with more than this part of all rows are broadcast by ``split_join``; there are fewer such keys than this.
PARTS = 1000
#: Up to so many keys are broadcast whole; a round of components makes several such tables, which the driver holds until it collects garbage.
BROADCAST_KEYS = 20_000


def split_join(big: DataFrame, small: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join on ``on`` of ``big`` and ``small``, which has one row a key and in ``n`` its rows in ``big``.

    Keys with more than ``total`` / PARTS rows are fewer than PARTS, since their rows sum to
    ``total`` at most: they are broadcast, so no hot key lands in one task. All others shuffle. As every key has
    a row, ``total`` bounds the keys too; up to BROADCAST_KEYS of them all are broadcast.
    """
    if total <= BROADCAST_KEYS:
        return big.join(F.broadcast(small), on)
    limit = max(1, total // PARTS)
    hot, cold = F.broadcast(small.where(F.col(n) > limit)), small.where(F.col(n) <= limit)
    return big.join(hot, on).unionByName(big.join(hot.select(on), on, "left_anti").join(merged(cold), on))


def merged(df: DataFrame) -> DataFrame:
    """With a hint to shuffle and merge. Spark's own choice goes by compressed bytes: ten MB of long keys or equal labels are over a hundred MB once broadcast."""
    return df.hint("merge")


def appended(df: DataFrame, path: str) -> DataFrame:
    """Append ``df`` to the table at ``path`` and read all of it back; a failed attempt leaves nothing."""
    spark = df.sparkSession
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile at most ``rows`` rows go to Python at once. Ten thousand, Spark's default, are some hundred MB in each worker and its task where rows are long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
