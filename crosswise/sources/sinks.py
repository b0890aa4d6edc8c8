"""Idempotent weekly publishing (K1-K6, K8)."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import require_none
from .storage import cut_lineage, list_files, week_files


def publish_plan(rows: DataFrame, root: str) -> DataFrame:
    """K1 dry run: what a backfill would do for each week.

    The JSON file names of a week are its already-published tickers; they are
    compared with the expected tickers by anti-join, not as driver-side sets.
    """
    spark = rows.sparkSession
    files = week_files(spark, root)
    existing = files.groupBy("week_date").agg(
        F.count(F.lit(1)).alias("existing_objects"),
        F.sum(F.when(F.col("path").endswith(".json"), 1).otherwise(0)).alias("n_json"),
    )
    expected = rows.groupBy("week_date").agg(F.count(F.lit(1)).alias("expected_stocks"))
    name = F.url_decode(F.regexp_extract("path", r"/([^/]+)\.json$", 1))
    stored = files.filter(F.col("path").endswith(".json")).select("week_date", name.alias("ticker"))
    absent = (
        rows.select("week_date", F.col("ticker").cast("string").alias("ticker"))
        .join(stored, ["week_date", "ticker"], "left_anti")
        .groupBy("week_date").agg(F.count(F.lit(1)).alias("n_absent"))
    )
    return (
        expected.join(existing, "week_date", "left").join(absent, "week_date", "left")
        .select(
            "week_date",
            "expected_stocks",
            F.coalesce("existing_objects", F.lit(0)).alias("existing_objects"),
            F.when(F.coalesce("existing_objects", F.lit(0)) > 0, "skip_existing").otherwise("upload").alias("action"),
            F.when(F.coalesce("n_json", F.lit(0)) > 0, F.coalesce("n_absent", F.lit(0))).alias("missing_expected_json_tickers"),
        )
    )


def stage_weeks(rows: DataFrame, root: str, partition: str = "week_date") -> str:
    """Write rows by week below a fresh hidden folder of root, which no reader lists. Rows of a
    week go to one writer unless the week is large: AQE's rebalance splits oversized weeks."""
    stage = f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    rows.hint("rebalance", partition).write.partitionBy(partition).parquet(stage)
    return stage


def claim_week(spark: SparkSession, stage: str, root: str, folder: str) -> bool:
    """Move a staged week into root; False if root holds that week by now. The rename refuses an
    existing target, so of two writers one gets the week, whole, and the other leaves it."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(f"{stage}/{folder}"), hadoop.Path(f"{root.rstrip('/')}/{folder}")
    files = hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    if files.util().exists(target):
        return False
    try:
        files.rename(source, target, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError:
        if files.util().exists(target):
            return False
        raise
    return True


def publish_weeks(rows: DataFrame, root: str, dry_run: bool = False, partition: str = "week_date", planned: DataFrame | None = None) -> DataFrame:
    """K1/K2/K8: publish only the weeks that root does not hold, then verify.

    Free weeks are staged in a hidden folder and claimed one by one by a rename, so readers see a
    whole week or none, and of several writers one publishes it. Weeks that were free when
    this writer, or the earlier plan it follows (`planned`, from publish_plan), looked and
    are another's now become skipped_concurrent_existing. A lost driver leaves whole weeks and
    a hidden folder; the next run publishes the rest. The renames are one a week, a bounded slice
    of the calendar. Root must be a file system whose rename is atomic. Returns one
    status row per week.
    """
    spark = rows.sparkSession
    stored = week_files(spark, root).select("week_date").distinct().withColumn("__stored", F.lit(True))
    weeks = rows.groupBy("week_date").agg(F.count(F.lit(1)).alias("rows"))
    free = (planned if planned is not None else weeks.withColumn("action", F.lit(None).cast("string"))).filter("action = 'upload'").select("week_date", F.lit(True).alias("__free"))
    decided = weeks.join(stored, "week_date", "left").join(free, "week_date", "left")
    new = "would_upload" if dry_run else "uploaded"
    old = "skip_existing" if dry_run else "skipped_existing"
    status = F.when(F.col("__stored").isNull(), new).when(F.col("__free"), "skipped_concurrent_existing").otherwise(old)
    decided = cut_lineage(decided.select("week_date", status.alias("status"), "rows"))
    if dry_run:
        return decided
    wanted = decided.filter(F.col("status") == new).select("week_date")
    days = sorted(row["week_date"] for row in wanted.collect())
    if not days:
        return decided
    stage = stage_weeks(rows.join(wanted, "week_date", "left_semi").select(*rows.columns), root, partition)
    lost = [(day,) for day in days if not claim_week(spark, stage, root, f"{partition}={day}")]
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    taken = spark.createDataFrame(lost, "week_date date").withColumn("__lost", F.lit(True))
    final = F.when(F.col("__lost"), "skipped_concurrent_existing").otherwise(F.col("status"))
    decided = decided.join(F.broadcast(taken), "week_date", "left").select("week_date", final.alias("status"), "rows")
    after = week_files(spark, root).select("week_date").distinct()
    require_none(decided.join(after, "week_date", "left_anti"), "Weeks missing after publishing")
    return decided


VOLATILE = ("published_at_utc", "upload")


def publish_manifest(spark: SparkSession, root: str, manifest: dict) -> str:
    """K3: write once; a second manifest must agree on every stable field."""
    path = f"{root.rstrip('/')}/_manifest"
    text = json.dumps(manifest, sort_keys=True)
    if list_files(spark, path).isEmpty():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return path
    stored = json.loads(spark.read.text(path).first()["value"])
    differing = sorted(k for k in set(manifest) - set(VOLATILE) if stored.get(k) != json.loads(text)[k])
    if differing:
        raise ValueError(f"Existing manifest describes a different panel: {differing}")
    return path


def write_outputs(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """K4/K5: one Parquet table per result."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def build_metadata(panel: DataFrame, training: DataFrame, inference: DataFrame, grid: DataFrame) -> DataFrame:
    """K4: one metadata row for a feature build."""
    newest = panel.agg(F.max("week_date").alias("inference_week"), F.count(F.lit(1)).alias("panel_rows"))
    missing = grid.agg(F.sum(F.when(F.col("adj_close").isNull(), 1).otherwise(0)).alias("missing_ticker_sessions"))
    return (
        newest.crossJoin(training.agg(F.count(F.lit(1)).alias("training_rows")))
        .crossJoin(inference.agg(F.count(F.lit(1)).alias("inference_rows")))
        .crossJoin(missing)
    )


def best_result(weekly: DataFrame, model: str, status: str) -> DataFrame:
    """K6: complete weeks of one model and status, without those columns."""
    return weekly.filter((F.col("model") == model) & (F.col("status") == status) & F.col("complete")).drop("model", "status")


def configuration_counts(candidates: DataFrame, model: str) -> DataFrame:
    return candidates.filter((F.col("model") == model) & F.col("selected")).groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n_weeks")
    )
