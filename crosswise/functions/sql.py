"""SQL surface: temporary views and SQL functions over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# SQL scalar functions (Spark SQL bodies, inlined by Catalyst).
SCALARS = {
    "ticker_key(t STRING) RETURNS STRING": "translate(upper(trim(t)), '.', '-')",
    "quintile_of(place BIGINT, n BIGINT) RETURNS INT": "CAST(floor((place - 1) * 5 / n) AS INT) + 1",
    "relevance_of(place DOUBLE, n BIGINT) RETURNS INT": "CAST(least(greatest(ceil(place / n * 5) - 1, 0), 4) AS INT)",
    "centered_percentile(avg_rank DOUBLE, n BIGINT) RETURNS DOUBLE": "(avg_rank - 0.5) / n",
    "dcg_gain(label DOUBLE, place BIGINT) RETURNS DOUBLE": "label / log2(place + 1)",
    "net_of_cost(gross DOUBLE, bps DOUBLE, traded DOUBLE) RETURNS DOUBLE": "gross - bps / 10000 * traded",
}


def register_sql(spark: SparkSession, views: dict[str, DataFrame] | None = None) -> list[str]:
    """Register the scalar functions and any operator results as views."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return [s.split("(")[0] for s in SCALARS]
