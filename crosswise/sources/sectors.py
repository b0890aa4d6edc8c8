"""Sector maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import require_none
from ..functions.columns import ticker_key


def union_maps(maps: Sequence[DataFrame]) -> DataFrame:
    """All maps with a priority (0 = strongest) and a normalized key."""
    out = None
    for priority, m in enumerate(maps):
        part = m.select(
            F.col("ticker").cast("string").alias("ticker"),
            F.trim(F.col("sector").cast("string")).alias("sector"),
            F.lit(priority).alias("priority"),
        )
        out = part if out is None else out.unionByName(part)
    keyed = out.withColumn("ticker_key", ticker_key("ticker"))
    return keyed.filter("ticker_key is not null and ticker_key <> '' and sector is not null and sector <> ''")


def map_conflicts(maps: Sequence[DataFrame]) -> DataFrame:
    """Keys with more than one distinct sector (min <> max needs no set)."""
    return (
        union_maps(maps).groupBy("ticker_key")
        .agg(F.min("sector").alias("lo"), F.max("sector").alias("hi"))
        .filter("lo <> hi").select("ticker_key")
    )


def load_sector_map(maps: Sequence[DataFrame], check: bool = True) -> DataFrame:
    if check:
        require_none(map_conflicts(maps), "Conflicting sector assignments")
    first = F.min(F.struct("priority", "ticker", "sector")).alias("r")
    return union_maps(maps).groupBy("ticker_key").agg(first).select(
        "ticker_key", F.col("r.ticker").alias("ticker"), F.col("r.sector").alias("sector")
    )


def constituents(raw: DataFrame, download_date=None) -> DataFrame:
    """Rename a constituent table and stamp the download date."""
    day = F.current_date() if download_date is None else F.lit(download_date).cast("date")
    return raw.select(
        ticker_key("Symbol").alias("ticker"),
        F.col("GICS Sector").alias("sector"),
        F.col("GICS Sub-Industry").alias("sub_industry"),
        day.alias("mapping_download_date"),
    )
