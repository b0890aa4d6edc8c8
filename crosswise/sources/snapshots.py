"""Versioned weekly snapshots."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import duplicate_keys, require_columns, require_none
from ..functions.columns import FEATURE_DIRECTIONS, clean_ticker
from .storage import list_files, week_files

REQUIRED = ("ticker", "week_date", "price_date", "adj_close")


def read_snapshots(spark: SparkSession, root: str, start=None, end=None, schema=None, check: bool = True) -> DataFrame:
    """Weeks stored as Parquet or JSON below root/.../week_date=*/.

    Partition columns come from the path and the week filter prunes folders.
    A (ticker, week) present in both formats is refused.
    """
    parts = []
    for fmt, glob in (("parquet", "*.parquet"), ("json", "*.json")):
        reader = spark.read.option("pathGlobFilter", glob).option("basePath", root)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            part = reader.format(fmt).load(root)
        except AnalysisException as error:
            # Nothing of this format below the root: no schema can be inferred.
            if error.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            continue
        if "week_date" not in part.columns:
            continue
        part = part.withColumn("week_date", F.to_date("week_date"))
        if start is not None:
            part = part.filter(F.col("week_date") >= F.lit(start).cast("date"))
        if end is not None:
            part = part.filter(F.col("week_date") <= F.lit(end).cast("date"))
        parts.append(part)
    if not parts:
        raise ValueError(f"No snapshot files below {root}")
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    require_columns(df, REQUIRED)
    df = df.withColumn("ticker", clean_ticker("ticker")).withColumn("price_date", F.to_date("price_date"))
    if check:
        require_none(duplicate_keys(df, ["ticker", "week_date"]), "Duplicate stock/week rows (overlapping JSON and Parquet?)")
    return df


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files per stored week."""
    return week_files(spark, root).groupBy("week_date").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes")
    )


def fingerprint(files: DataFrame, root: str) -> DataFrame:
    """One sha256 over the sorted listing (relative path, size, time).

    Hashed in two levels, folder then root, so no row holds the whole listing.
    """
    key = F.replace("path", F.lit(root), F.lit(""))
    entry = F.sha2(F.to_json(F.struct(key.alias("key"), "bytes", F.col("modified").cast("long").alias("modified"))), 256)
    folder = F.regexp_extract(key, r"^(.*)/[^/]*$", 1).alias("folder")
    per_folder = files.select(folder, entry.alias("h")).groupBy("folder").agg(
        F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h"), F.count(F.lit(1)).alias("n")
    )
    listed = F.sort_array(F.collect_list(F.struct("folder", "h")))
    return per_folder.agg(
        F.sha2(F.to_json(listed), 256).alias("fingerprint"), F.sum("n").alias("n_files")
    )


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def panel_scan(spark: SparkSession, table: str, start: str, end: str | None = None,
               features: Sequence[str] = tuple(FEATURE_DIRECTIONS), ordered: bool = True) -> DataFrame:
    """Explicit columns of a panel table for an inclusive week range.

    Values travel as parameters; the date-typed literals keep partition pruning.
    """
    for part in table.split("."):
        if not IDENTIFIER.fullmatch(part):
            raise ValueError(f"Invalid SQL identifier: {part!r}")
    for name in features:
        if not IDENTIFIER.fullmatch(name):
            raise ValueError(f"Invalid SQL identifier: {name!r}")
    columns = ["ticker", "sector", "week_date", "prev_week_date", *features,
               *[f"{f}_train" for f in features], "active_return_train", "active_return_fwd"]
    where = "week_date >= cast(:start as date)" + (" AND week_date <= cast(:end as date)" if end else "")
    args = {"t": table, "start": start, **({"end": end} if end else {})}
    df = spark.sql(f"SELECT {', '.join(columns)} FROM IDENTIFIER(:t) WHERE {where}", args=args)
    return df.orderBy("week_date", "ticker") if ordered else df


def read_events(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Corporate events, as one JSON array or (array=False) JSON lines,
    which Spark can split over tasks."""
    schema = ("ticker string, week_date date, next_week_date date, event_date date, event_type string, "
              "cash_per_share double, start_close double, source_url string")
    return spark.read.schema(schema).option("multiLine", array).json(path)


SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


def _format_of(path: str) -> str:
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported table format: {suffix}")
    return SUFFIXES[suffix]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Format by suffix."""
    fmt = _format_of(path)
    reader = spark.read.format(fmt)
    return (reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader).load(path)


def write_table(df: DataFrame, path: str) -> None:
    fmt = _format_of(path)
    writer = df.write.format(fmt).mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def cached_result(spark: SparkSession, folder: str, identity: str, build, refresh: bool = False) -> DataFrame:
    """K7: reuse the stored result of an identical request. A marker written
    after the result tells a finished one from an interrupted one."""
    path = f"{folder.rstrip('/')}/result_{hashlib.sha256(identity.encode()).hexdigest()[:16]}"
    marker = f"{path}_done"
    if refresh or list_files(spark, marker).isEmpty():
        build().write.mode("overwrite").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(marker)
    return spark.read.parquet(path)
