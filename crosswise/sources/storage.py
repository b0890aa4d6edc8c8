"""Where jobs keep intermediate tables, and file listings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A machine-local folder is used only in local mode with nothing configured.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
        root = os.path.join(tempfile.gettempdir(), "crosswise-checkpoints")
    return f"{root.rstrip('/')}/crosswise/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reliable copy and continue from it; the copy goes when the application ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


EMPTY_LISTING = "path string, modified timestamp, bytes long"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of all files below root; contents are pruned, never read."""
    try:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(root)
            .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EMPTY_LISTING)
    return found


def week_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing with the week_date recovered from the path."""
    week = F.regexp_extract("path", r"week_date=(\d{4}-\d{2}-\d{2})/", 1)
    return list_files(spark, root).withColumn("week_date", F.try_to_timestamp(F.nullif(week, F.lit(""))).cast("date")).filter(
        "week_date is not null and not path rlike '/[_.][^/]*$'"
    )
