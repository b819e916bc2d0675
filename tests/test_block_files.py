"""Files of blocks: row groups of few rows, whatever a task writes."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.operators import blocks


def test_row_groups_hold_few_blocks(spark):
    edges = spark.range(2000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 2000).alias("dst")).coalesce(1)
    b = blocks.store(edges, block=16)
    files = [pq.ParquetFile(p) for p in Path(b.rows._quern_path).glob("*.parquet")]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(groups) >= 125 and max(groups) <= 4
    assert b.edges().count() == 2000
