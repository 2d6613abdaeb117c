"""Helpers of this subpackage: cutting lineage, ids of any type, reading tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the folder the cluster names; one of its own only on a single machine where none is set, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkstrata-"))
    return df.checkpoint()


#: Code points that are worked on at once: bounds a worker's memory whatever the batch and the texts' lengths.
CHARS = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], *columns: int, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``chars`` code points of the text columns (a longer text alone)."""
    for b in batches:
        size = np.cumsum(sum(np.asarray(pc.fill_null(pc.utf8_length(b.column(c)), 0)) for c in columns))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, "right")))
            yield b.slice(at, end - at)
            at = end
