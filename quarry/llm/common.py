"""What the training-data operators share: reading tables, scratch tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import shared_dir

#: Rows that a Python worker turns into Python objects at once.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes what a query has shuffled when the query ends; otherwise it stays until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_scratch(df: DataFrame, name: str, **options: str) -> str:
    """Writes df as Parquet into the shared folder and returns the path: lineage ends there, a lost executor loses nothing, and no shuffle files stay."""
    conf = df.sparkSession.conf
    path, before = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a scratch table, wherever Hadoop's file systems keep it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Scratch tables of one job. Those that it still holds when its block ends are removed; what is to outlive it is written with write_scratch.

    A table is dropped as soon as nothing reads it any more, so that the store holds a few steps of a job and not all of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = write_scratch(df, name)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(read)] = (read, path)
        return read

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            found = self.held.pop(id(t), None)
            if found:
                remove(self.spark, found[1])

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.held.values()])


def materialise(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))


#: What this Python worker keeps from task to task, with the turn that used it last; after UNUSED tasks without it, it goes.
UNUSED = 2
_kept: dict[tuple, list] = {}
_turn = [0]


def kept(key: tuple, make):
    """make(), kept in the worker under key while its tasks use it. Other stages' tasks in the same worker have the memory to themselves."""
    if key not in _kept:
        _kept[key] = [0, make()]
    _kept[key][0] = _turn[0]
    return _kept[key][1]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows, so that few texts are Python objects at a time."""
    _turn[0] += 1
    for key in [k for k, (turn, _) in _kept.items() if _turn[0] - turn > UNUSED]:
        del _kept[key]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have most_bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            gone = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, gone + most_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def whole_text(column: str = "text"):
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
