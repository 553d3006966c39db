"""Noise control over a stream of decisions, with the state of each trigger kept across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.monitoring import NOISE, step

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Triggers(StatefulProcessor):
    """Of each topic: hits in a row and the last emission. A batch's decisions of a topic are taken by time; batches as they come."""

    def __init__(self, hysteresis: int, cooldown_minutes: int):
        self.hysteresis, self.cooldown = hysteresis, pd.Timedelta(minutes=max(0, cooldown_minutes))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trigger", "hits int, last timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        hits, last = 0, None
        if self.state.exists():
            hits, last = self.state.get()
            last = None if last is None or pd.isna(last) else pd.Timestamp(last)
        out = []
        for at, fired in pd.concat(list(rows))[["at", "fired"]].sort_values("at", kind="stable").itertuples(index=False):
            emitted, why, hits, last = step(bool(fired), at, hits, last, self.hysteresis, self.cooldown)
            out.append((key[0], at, bool(fired), emitted, why))
        self.state.update((hits, None if last is None else last.to_pydatetime()))
        yield pd.DataFrame(out, columns=["topic", "at", "fired", "emitted", "suppressed_by"])

    def close(self) -> None:
        pass


def controlled(decisions: DataFrame, hysteresis: int, cooldown_minutes: int) -> DataFrame:
    """topic, at, fired, emitted, suppressed_by of a streamed log decisions(topic, at, fired), one row for each.

    The same as monitoring.noise_control over the whole log, as long as no batch brings a decision of a topic that is older
    than one that has been judged. A batch's decisions of one topic are held together, two columns of them. Null: not fired.
    """
    rows = decisions.selectExpr("topic", "at", "coalesce(fired, false) AS fired")
    return rows.groupBy("topic").transformWithStateInPandas(Triggers(hysteresis, cooldown_minutes), NOISE, "append", "none")


def drain(spark: SparkSession, decisions: DataFrame, place: str, hysteresis: int, cooldown_minutes: int) -> None:
    """Judges what has arrived in the log and appends it to place/rows; states and offsets are kept in place/offsets for the next call."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        out = controlled(decisions, hysteresis, cooldown_minutes).writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/offsets")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
