"""Versions of a stored table set: what is written stays unseen until the version that names it is there as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest(spark: SparkSession, place: str) -> int:
    """The newest version under place that was written to its end; 0 if there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return 0
    named = [f.getPath() for f in files.listStatus(top) if f.getPath().getName().startswith("version=")]
    return max((int(p.getName()[8:]) for p in named if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=0)


def commit(manifest: DataFrame, place: str, after: int) -> int:
    """Writes the version that follows `after`. Of two writers that saw the same version the later one fails and changes nothing."""
    manifest.write.mode("errorifexists").parquet(f"{place}/version={after + 1}")
    return after + 1


def read(spark: SparkSession, place: str, version: int | None = None) -> DataFrame:
    version = version or latest(spark, place)
    if not version:
        raise FileNotFoundError(f"no version under {place}")
    return spark.read.parquet(f"{place}/version={version}").withColumn("version", F.lit(version))
