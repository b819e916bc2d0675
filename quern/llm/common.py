"""Helpers shared by the training-data operators: inputs and shared-folder tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.plans.tables import PARTS, appended, arrow_batches, drop_all, drop_written, merged, named_path, scratch, shared_dir, split_join, written

__all__ = ["PARTS", "TYPES", "appended", "arrow_batches", "drop_all", "drop_written", "merged", "named_path", "scratch", "shared_dir", "split_join", "struct", "table", "written"]

TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(T.IntegerType()),
}


def struct(fields: str) -> T.StructType:
    """The type of "name type, ..." without a running session, so that modules import early."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (f.split(" ") for f in fields.split(", "))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
