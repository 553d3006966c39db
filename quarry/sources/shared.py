"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session (tests) may leave it unset: then one is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Removes what a query has shuffled when the query ends; otherwise it stays until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """What queries shuffle within goes with each of them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Between:
    """Tables that a job writes and reads back (as written()), removed when its block ends or when they are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place = spark, f"{shared_dir(spark)}/between-{uuid.uuid4().hex}"
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Between:
        return self

    def written(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = f"{self.place}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(read)] = (read, path)
        return read

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(self.held.pop(id(t))[1])

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_) -> None:
        self._remove(self.place)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet into the shared folder and read back: made once, and safe from lost executors. The table stays."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
