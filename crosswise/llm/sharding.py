"""Two-pass external shuffle into shards.

Pass one scatters the records with a seeded hash, uniformly, into buckets that fit a
task's memory. Pass two takes bucket after bucket, shuffles it in memory (Fisher-Yates,
seeded by the bucket) and writes it. Bucket sizes are counted beforehand, so every record
gets its place in the whole order, and the order is cut into shards whose counts differ
by one at most.

Defined results: null keys and texts hash like any value; repeated rows are shuffled one
by one (rows equal in key and text share a bucket); an empty table gives no rows. The
order depends on seed and rows only, not on how the input is divided.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crosswise.sources.storage import shared_folder

from .tasks import free_name

SHARDS = 24
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of n places: from the end, each swaps with one not yet passed."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else order
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write all rows, shuffled, below `folder` (default: the shared folder), in
    subfolders by shard, and return them with `shard` and `slot` (gapless from 0)."""
    spark = docs.sparkSession
    mix, bucket, base, place = (free_name(docs, n) for n in ("mix", "bucket", "base", "place"))
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(F.octet_length(t), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(total["bytes"] / bucket_bytes))
    hashed = docs.withColumn(mix, F.xxhash64(F.lit(seed), k, t)).withColumn(bucket, F.pmod(F.col(f"`{mix}`"), F.lit(buckets)))
    counts = hashed.groupBy(bucket).agg(F.count("*").alias("n"))
    # One row per bucket: the only unpartitioned window is over this table.
    bases = counts.select(bucket, F.coalesce(F.sum("n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    out = T.StructType([*docs.schema.fields, T.StructField(place, T.LongType())])
    arrow = to_arrow_schema(out)

    def shuffle(rows: pa.Table, starts: pa.Table) -> pa.Table:
        number, hashes = int(rows.column(len(arrow))[0].as_py()), rows.column(len(arrow) - 1).to_numpy()
        fixed = np.argsort(hashes, kind="stable")
        order = fixed[fisher_yates(len(fixed), np.random.default_rng([seed, number]))]
        first = starts.column(1)[0].as_py()
        moved = rows.take(pa.array(order))
        return pa.Table.from_arrays([*(moved.column(i).cast(arrow.field(i).type) for i in range(len(arrow) - 1)), pa.array(np.arange(first, first + len(order)))], schema=arrow)

    placed = hashed.groupBy(bucket).cogroup(bases.groupBy(bucket)).applyInArrow(shuffle, out)
    n = max(1, total["n"])
    cut = F.expr(f"cast((`{place}` * {shards}L) div {n}L as int)")
    head = F.expr(f"(`{shard}` * {n}L + {shards - 1}L) div {shards}L")
    path = folder or shared_folder(spark)
    placed.withColumn(shard, cut).withColumn(slot, F.col(f"`{place}`") - head).drop(place).write.partitionBy(shard).parquet(path)
    schema = T.StructType([*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
