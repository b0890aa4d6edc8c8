"""Feature messages: encoding, publishing and parsing (M1-M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite

IDENTIFIERS = ("feature_version", "data_version", "week_date", "price_date", "Ticker")


def message_schema(features: Sequence[str]) -> T.StructType:
    text = [T.StructField(c, T.StringType()) for c in IDENTIFIERS]
    numbers = [T.StructField(c, T.DoubleType()) for c in ("adj_close", *features)]
    return T.StructType([*text, *numbers])


def message_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def to_messages(snapshot: DataFrame, features: Sequence[str], feature_version: str, data_version: str) -> DataFrame:
    """M1: one JSON message per stock; identifiers, price and features only, so
    a label cannot leak. Missing values are written as null, never NaN."""
    body = F.struct(
        F.lit(feature_version).alias("feature_version"),
        F.lit(data_version).alias("data_version"),
        F.col("ticker").cast("string").alias("Ticker"),
        F.date_format("week_date", "yyyy-MM-dd").alias("week_date"),
        F.date_format("price_date", "yyyy-MM-dd").alias("price_date"),
        F.col("adj_close").cast("double").alias("adj_close"),
        *[F.round(finite(F.col(f).cast("double")), 15).alias(f) for f in features],
    )
    return snapshot.select(body.alias("m")).select(
        message_key(F.col("m.feature_version"), F.col("m.data_version"), F.col("m.week_date"), F.col("m.Ticker")).alias("key"),
        F.to_json("m", {"ignoreNullFields": "false"}).alias("value"),
    )


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """M2: keyed batch publish, acknowledged by all replicas."""
    (
        messages.select("key", "value").write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.retries", "3")
        .option("kafka.max.in.flight.requests.per.connection", "1")
        .option("topic", topic)
        .save()
    )


def subscribe(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """M4 source: a new query reads retained messages from the earliest offset;
    a restarted one resumes from its checkpoint."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")
    )


def once(df: DataFrame, kept: Sequence[str], **made: Column) -> DataFrame:
    """`kept` and the columns `made`, as generated values: the optimizer puts a plain column's text
    in place of its name, so that a later filter would make and parse a message once per condition."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def parse(messages: DataFrame, features: Sequence[str], feature_version: str) -> DataFrame:
    """M3: typed columns plus `problem`, missing for a valid message.

    A feature must be present as a JSON field; its value may be null.
    """
    others = [c for c in messages.columns if c != "value"]
    parsed = once(once(messages, others, value=F.col("value")), [*others, "value"], m=F.from_json("value", message_schema(features)), __fields=F.json_object_keys("value"))
    fields = F.col("__fields")
    present = F.size(F.array_except(F.array(*[F.lit(f) for f in features]), F.coalesce(fields, F.array().cast("array<string>")))) == 0
    absent = F.lit(False)
    for c in IDENTIFIERS:
        absent = absent | F.col(f"m.{c}").isNull() | (F.col(f"m.{c}") == "")
    problem = (
        F.when(fields.isNull(), "not_json")
        .when(absent, "missing_identifiers")
        .when(F.col("m.feature_version") != feature_version, "unexpected_feature_version")
        .when(~present, "missing_features")
    )
    return parsed.select(
        *others, "value", problem.alias("problem"),
        F.col("m.feature_version").alias("feature_version"), F.col("m.data_version").alias("data_version"),
        F.to_date("m.week_date").alias("week_date"), F.to_date("m.price_date").alias("price_date"),
        F.col("m.Ticker").alias("ticker"), F.col("m.adj_close").alias("adj_close"),
        *[F.col(f"m.{f}").alias(f) for f in features],
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem is null").drop("problem")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem is not null").select(*[c for c in ("key", "value", "problem") if c in parsed.columns])


def strict(parsed: DataFrame) -> DataFrame:
    """Stop the query at a bad record, so its offset is not committed."""
    stop = F.raise_error(F.concat(F.lit("Invalid feature message: "), F.col("problem"))).cast("boolean")
    # A filter (unlike an unused column) is always evaluated.
    return parsed.filter(F.when(F.col("problem").isNull(), True).otherwise(stop)).drop("problem")
