"""Daily price sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import require_none


def read_prices(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Three columns of a price CSV. Values are read as text and converted
    with a failing cast, so a malformed price or date is an error, not a NULL."""
    raw = spark.read.option("header", True).csv(path).select(
        F.trim("Ticker").alias("ticker"),
        F.to_date(F.substring("Date", 1, 10)).alias("date"),
        F.col("Adj Close").cast("double").alias("adj_close"),
    )
    if check:
        if raw.isEmpty():
            raise ValueError("Empty price data")
        require_none(price_violations(raw), "Invalid price rows")
    return raw


def price_violations(prices: DataFrame) -> DataFrame:
    """Missing keys, duplicate keys and unusable prices, one row per key.

    One aggregate, combined map-side: a key repeated a billion times shuffles
    one partial row per task.
    """
    p = F.col("adj_close")
    unusable = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")) | (p <= 0)
    grouped = prices.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(unusable, 1).otherwise(0)).alias("n_unusable"),
    )
    problem = (
        F.when(F.col("ticker").isNull() | (F.trim(F.col("ticker").cast("string")) == "") | F.col("date").isNull(), "missing_key")
        .when(F.col("n_rows") > 1, "duplicate_key")
        .when(F.col("n_unusable") > 0, "invalid_price")
    )
    return grouped.select("ticker", "date", problem.alias("problem"), "n_rows").filter("problem is not null")


def as_of(prices: DataFrame, cutoff=None, check: bool = True) -> DataFrame:
    """Keep dates up to the cutoff (default: newest date) before features."""
    if cutoff is None:
        return prices  # the newest date keeps every row
    kept = prices.filter(F.col("date") <= F.lit(cutoff).cast("date"))
    if check and kept.isEmpty():
        raise ValueError("As-of precedes the data")
    return kept


OHLC = ("open", "high", "low", "close")


def normalize_ohlcv(raw: DataFrame, data_source: str, order_by: tuple[str, ...] = ()) -> DataFrame:
    """S3: provider frame -> one clean row per (asset_id, date).

    Duplicates keep the first row under an explicit order; `min` over a struct
    combines map-side, so a hot asset is never gathered in one task.
    """
    df = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    missing = sorted({"date", "ticker", *OHLC, "volume"} - set(df.columns))
    if missing:
        raise ValueError(f"Provider data lacks columns: {missing}")
    values = [*OHLC, "volume", *(["adj_close"] if "adj_close" in df.columns else [])]
    first = [c for c in order_by] + [v for v in values if v not in order_by]
    clean = df.dropna(subset=list(OHLC)).withColumn("date", F.to_date("date"))
    return (
        clean.groupBy(F.col("ticker"), F.concat(F.lit("US_"), F.col("ticker").cast("string")).alias("asset_id"), "date")
        .agg(F.min(F.struct(*first)).alias("r"))
        .select("date", *[F.col(f"r.{v}").alias(v) for v in values], "ticker", "asset_id", F.lit(data_source).alias("data_source"))
    )


def append_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows after the stored cutoff, first row per key."""
    cutoff = stored.agg(F.max("date").alias("__cutoff"))
    fresh = incoming.crossJoin(F.broadcast(cutoff)).filter(F.col("__cutoff").isNull() | (F.col("date") > F.col("__cutoff")))
    return fresh.groupBy("ticker", "date").agg(F.min("adj_close").alias("adj_close"))


def append_report(stored: DataFrame, incoming: DataFrame, jump: float = 0.5) -> DataFrame:
    """What an append would bring: duplicates, absent tickers, missing
    Wednesdays and price jumps, as (problem, n) rows."""
    cutoff = stored.agg(F.max("date").alias("__cutoff"))
    fresh = incoming.crossJoin(F.broadcast(cutoff)).filter("date > __cutoff")
    duplicates = fresh.groupBy("ticker", "date").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
    absent = stored.select("ticker").distinct().join(fresh.select("ticker"), "ticker", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    span = fresh.agg(F.min("__cutoff").alias("lo"), F.max("date").alias("hi"))
    expected = span.select(F.explode(F.expr("filter(sequence(date_add(lo, 1), hi), d -> weekday(d) = 2)")).alias("date"))
    holes = expected.join(fresh.select("date"), "date", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    newest = stored.groupBy("ticker").agg(F.max_by("adj_close", "date").alias("last_close"))
    opening = fresh.groupBy("ticker").agg(F.min(F.struct("date", "adj_close")).alias("r")).select(
        "ticker", F.col("r.adj_close").alias("first_close")
    )
    jumps = opening.join(newest, "ticker").filter(F.abs(F.col("first_close") / F.col("last_close") - 1) > jump).agg(F.count(F.lit(1)).alias("n"))
    parts = [("duplicate_key", duplicates), ("absent_ticker", absent), ("missing_wednesday", holes), ("price_jump", jumps)]
    out = None
    for name, part in parts:
        row = part.select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out
