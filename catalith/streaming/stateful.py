"""Last-known-good state of every entity, kept by Spark's state store.

Outcomes arrive as a stream; the state of an entity (its last good value, when that was, whether the newest outcome
failed, and how many there were) is a row of the state store, so a micro-batch touches the entities
that it has outcomes for and nothing else.  What changed is written as a part of its own per
micro-batch, which a repeated batch overwrites; ``latest`` reads the newest row of each entity.

Order doesn't matter: an outcome that is older than what is known changes counts only.  Of equal times the
greater value counts, and a failure before a success.  Where ``expire`` is given, outcomes older than the watermark are
dropped and an entity without an outcome for that long is marked stale by a timer.  Null ids are an entity of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "good_at long, value double, last_at long, failed boolean, n_refreshed long, n_failed long"
_OUT = "id long, value double, stale boolean, n_refreshed long, n_failed long, last_at long"


class LastGood(StatefulProcessor):
    """Folds an entity's outcomes (at in microseconds, value, failed) into its state."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _STATE)

    def _row(self, key: Any, state: tuple) -> pd.DataFrame:
        _, value, last_at, failed, n_refreshed, n_failed = state
        return pd.DataFrame({"id": [key[0]], "value": [value], "stale": [failed], "n_refreshed": [n_refreshed], "n_failed": [n_failed], "last_at": [last_at]}).astype({"value": "float64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        good_at, value, last_at, failed, n_refreshed, n_failed = self.known.get() if self.known.exists() else (None, None, None, None, 0, 0)
        for part in rows:
            bad = part["failed"].astype(bool)
            good = part[~bad]
            n_refreshed, n_failed = n_refreshed + len(good), n_failed + int(bad.sum())
            if len(good):
                best = good.sort_values(["at", "value"], na_position="first").iloc[-1]
                mine = (int(best["at"]), None if pd.isna(best["value"]) else float(best["value"]))
                if good_at is None or (mine[0], mine[1] is not None, mine[1] or 0.0) > (good_at, value is not None, value or 0.0):
                    good_at, value = mine
            newest = int(part["at"].max())
            its = bool(bad[part["at"] == newest].any())
            if last_at is None or newest > last_at or (newest == last_at and its):
                last_at, failed = newest, its
        state = (good_at, value, last_at, failed, n_refreshed, n_failed)
        self.known.update(state)
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last_at // 1000 + self.expire_ms)
        yield self._row(key, state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        good_at, value, last_at, _, n_refreshed, n_failed = self.known.get()
        state = (good_at, value, last_at, True, n_refreshed, n_failed)
        self.known.update(state)
        yield self._row(key, state)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers needs Spark's RocksDB store; a query takes the setting when it starts."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def start(outcomes: DataFrame, table: str, checkpoint: str, key: str, time: str, value: str, failed: Column, expire: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Run the stream over all outcomes that are there, from where ``checkpoint`` says; changes go to ``table``."""
    spark = outcomes.sparkSession
    stamped = outcomes.select(F.col(key).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"), F.coalesce(failed, F.lit(False)).alias("failed"))
    stamped = stamped.withColumn("at", F.unix_micros("ts"))
    expire_ms = None
    if expire is not None:
        stamped = stamped.withWatermark("ts", late)
        expire_ms = int(pd.Timedelta(expire).total_seconds() * 1000)
    changed = stamped.groupBy("id").transformWithStateInPandas(LastGood(expire_ms), _OUT, "Update", "EventTime" if expire is not None else "None")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with _rocks(spark):
        return changed.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest state of every entity."""
    kept = ["value", "stale", "n_refreshed", "n_failed", "last_at"]
    parts = spark.read.option("basePath", table).parquet(f"{table}/batch=*")
    return parts.groupBy("id").agg(F.max_by(F.struct(*kept), F.col("batch")).alias("_s")).select("id", "_s.*")
