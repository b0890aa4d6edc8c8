"""Streaming sinks (M4-M7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import cut_lineage

KEY = ("feature_version", "data_version", "week_date", "ticker")


def land_features(parsed: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """M4: at-least-once delivery made idempotent.

    Each micro-batch overwrites its own folder batch=<id>; offsets commit after
    the write. A replayed batch rewrites the same folder, and readers resolve a
    key to its newest batch, so replays never duplicate a row. No stored week is
    read or rewritten while the stream runs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, root: str, key: Sequence[str] = KEY, order: Sequence[str] = ("batch",)) -> DataFrame:
    """Newest row per key: max over an ordered struct combines map-side."""
    stored = spark.read.option("basePath", root).parquet(root)
    rest = [c for c in stored.columns if c not in key and c not in order]
    newest = stored.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return newest.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def land_raw(messages: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """M5: every message as it arrived, one JSON line each."""
    writer = messages.select("value").writeStream.format("text").option("path", root).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact(landed: DataFrame, root: str) -> None:
    """M6: small files -> Parquet partitioned by week; oversized weeks are
    split over several files, small ones share a task."""
    landed.hint("rebalance", "week_date").write.mode("overwrite").partitionBy("week_date").parquet(root)


def weekly_completeness(parsed: DataFrame) -> DataFrame:
    """M7: distinct messages per week. The keys seen stay in the state store without a horizon, so
    a replay never counts twice, however late; they are as many as the stored rows of all weeks.
    That state is keyed by message (evenly spread, no week in one task), and the weekly count is
    combined before its shuffle. Keep it on disk with RocksDB, `spark.sql.streaming.stateStore.providerClass`."""
    return parsed.dropDuplicates(list(KEY)).groupBy("week_date").agg(F.count(F.lit(1)).alias("n_received"))


def announce_ready(counts: DataFrame, expected: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """M7: emit one `weekly-data-ready` row per week once every expected stock
    has arrived. expected: (week_date, n_expected)."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ready = batch.join(expected, "week_date").filter("n_received >= n_expected").select(
            "week_date", F.lit("weekly-data-ready").alias("event"), "n_received", "n_expected"
        )
        # Only earlier batches count as announced; a replay rewrites its folder.
        try:
            past = spark.read.option("basePath", root).parquet(root).filter(F.col("batch") < batch_id).select("week_date")
            ready = ready.join(past, "week_date", "left_anti")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        # Reading and overwriting the same root: the week list is stored elsewhere
        # before the write starts.
        cut_lineage(ready).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def inference_completed(ready: DataFrame, predictions: DataFrame) -> DataFrame:
    """M7: ready weeks whose predictions cover every received stock."""
    scored = predictions.groupBy("week_date").agg(F.count("prediction").alias("n_scored"))
    return ready.join(scored, "week_date").filter("n_scored >= n_received").select(
        "week_date", F.lit("inference-completed").alias("event"), "n_scored"
    )
