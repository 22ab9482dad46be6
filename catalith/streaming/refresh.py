"""Refresh outcomes as a stream.

An extension of the batch upsert: outcomes arrive as files, every micro-batch is applied
to the stored entities under last-known-good rules, and the new table replaces the old by
version, so readers see whole tables only and a repeated batch writes the same version.  The
time of the outcome that an entity shows is kept in ``outcome_at``: an older outcome that comes
late changes nothing.  Of the versions the last two stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from catalith.operators.relations import upsert_metrics


def apply_outcomes(spark: SparkSession, source: str, schema: StructType, tables: str, checkpoint: str) -> StreamingQuery:
    """Start the stream: ``tables``/v=N holds the entities after micro-batch N - 1; ``tables``/v=0 is the start."""

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        entities = session.read.parquet(f"{tables}/v={number}")
        if "outcome_at" not in entities.columns:
            entities = entities.withColumn("outcome_at", F.lit(None).cast(batch.schema["at"].dataType))
        newest = batch.groupBy("id").agg(F.max_by(F.struct("new_metrics", "failure", "at"), F.col("at")).alias("_o")).select("id", "_o.*")
        shown = entities.select(F.col("id").alias("_id"), "outcome_at")
        fresh = newest.join(shown, F.col("id") == F.col("_id")).where("outcome_at IS NULL OR at > outcome_at").select("id", "new_metrics", "failure", "at")
        done = upsert_metrics(entities, fresh).join(fresh.select(F.col("id").alias("_id"), F.col("at").alias("_at")), F.col("id") == F.col("_id"), "left")
        done = done.withColumn("outcome_at", F.coalesce("_at", "outcome_at")).drop("_id", "_at")
        done.write.mode("overwrite").parquet(f"{tables}/v={number + 1}")
        old = session.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tables}/v={number - 1}")
        old.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Refreshed and failed outcomes per window of an event stream or table."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, width)).agg(F.count_if(F.col("event_type") == "error").alias("n_failed"), F.count_if(F.col("event_type") != "error").alias("n_refreshed"))
