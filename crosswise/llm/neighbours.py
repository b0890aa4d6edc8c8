"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has its own k-means codebook, fitted on a bounded sample; a
vector's cell is its pair of nearest centroids, and every vector is indexed. A query
walks the centroid pairs in order of their summed distance with a heap until the cells it
has taken hold enough entries, and those entries are reranked by the exact inner product.

Cells are stored in blocks of a bounded number of entries (large cells are split) and
queries come in bounded chunks, so a task holds one block and one chunk. Equal vectors
are one entry: of their ids only the smallest k + 1 can ever be among k results, which
keeps the result exact for any number of copies.

Defined results: vectors that are null, zero, of another length than the most common one
(ties: the shorter) or hold null or non-finite components take no part, neither as
queries nor as candidates; a null id likewise; an empty table gives no rows; repeated
(id, vector) rows count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

CENTROIDS = 64
SAMPLE = 20_000
ROUNDS = 12
#: Entries a query looks at: this share of all, and this many at least. Vectors without
#: cluster structure need a large share for a recall of 0.9; clustered ones far less.
PROBE_SHARE = 0.45
PROBE_LEAST = 4096
BLOCK = 8192
CHUNK = 1024


def k_means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from k distinct sampled points."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(points, centroids)
        size = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, axis=1)


def walk_pairs(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Cells (i * len(second) + j) in order of first[i] + second[j] until they hold enough entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, width = first[a].tolist(), second[b].tolist(), len(second)
    grid = sizes.reshape(len(first), width)[np.ix_(a, b)]
    rows = [r.tolist() for r in grid]
    heap, cells, held = [(da[0] + db[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := rows[i][j]:
            cells.append(int(a[i]) * width + int(b[j]))
            held += n
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        if j + 1 < width:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
    return np.array(cells, np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, vec in double precision."""
    v = F.col("vec")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size(v) == (length[0]["n"] if length else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best found among all rows but its own."""
    spark = vectors.sparkSession
    # -0.0 and 0.0 are one value in grouping keys.
    rows = usable(vectors, key, vector).dropDuplicates(["id", "vec"])
    turn = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = rows.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = cut_lineage(entries.select("ids", "vec"))
    sample = entries.orderBy(F.xxhash64("vec"), F.element_at("ids", 1)).limit(SAMPLE).toArrow()  # at most SAMPLE rows
    asked = usable(queries, key, vector).dropDuplicates(["id", "vec"])
    schema = "query_id long, rank int, vec_id long, score double"
    if sample.num_rows == 0:
        return spark.createDataFrame([], schema)
    points = matrix(sample.column("vec"))
    half = max(1, points.shape[1] // 2)
    books = [k_means(points[:, :half], CENTROIDS, 1), k_means(points[:, half:], CENTROIDS, 2) if points.shape[1] > half else np.zeros((1, 0))]
    width, cells = len(books[1]), len(books[0]) * len(books[1])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            cell = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "ids", "vec"])

    indexed = cut_lineage(entries.mapInArrow(assign, "cell long, ids array<bigint>, vec array<double>"))
    sizes = np.zeros(cells, np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most CENTROIDS squared rows
        sizes[r["cell"]] = r["n"]
    enough = max(PROBE_LEAST, int(probe_share * sizes.sum()))
    # Cells in order fill blocks; a cell beyond a block's size takes several, by hash.
    block_of, parts, block, filled = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0, 0
    for c in np.flatnonzero(sizes):
        if filled and filled + sizes[c] > BLOCK:
            block, filled = block + 1, 0
        block_of[c], parts[c] = block, max(1, -(-int(sizes[c]) // BLOCK))
        filled += int(sizes[c])
        if parts[c] > 1:
            block, filled = block + int(parts[c]), 0
    chunks = max(1, -(-asked.count() // CHUNK))

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, salt = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            place = block_of[cell] + (salt.astype(np.uint64) % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), *batch.columns[:3]], ["block", "cell", "ids", "vec"])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            # Nearness is the inner product, so a centroid's distance is its negative.
            far1, far2 = -x[:, :half] @ books[0].T, -x[:, half:] @ books[1].T
            for i in range(len(x)):
                taken = walk_pairs(far1[i], far2[i], sizes, enough)
                # A block's cells stand together: one row for each block that holds any.
                order = np.sort(taken)
                spread = np.concatenate([np.repeat(block_of[order], parts[order]) + np.concatenate([np.arange(p) for p in parts[order]])]) if len(order) else order
                wide = np.repeat(order, parts[order])
                places, begin = np.unique(spread, return_index=True)
                lists = [a.tolist() for a in np.split(wide, begin[1:])]
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([x[i].tolist()] * n, pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int64()))],
                    ["block", "query_id", "vec", "cells"],
                )

    located = indexed.withColumn("salt", F.xxhash64("vec")).mapInArrow(locate, "block long, cell long, ids array<bigint>, vec array<double>")
    located = located.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread_out = asked.repartition(max(1, chunks) * 4, "id")
    routed = spread_out.mapInArrow(route, "block long, query_id long, vec array<double>, cells array<bigint>").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))

    def rerank(held: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if held.num_rows and wanted.num_rows:
            cell, x = held.column("cell").to_numpy(), matrix(held.column("vec"))
            ids = held.column("ids").to_pylist()
            q, names, lists = matrix(wanted.column("vec")), wanted.column("query_id").to_pylist(), wanted.column("cells").to_pylist()
            taken = np.zeros(cells, dtype=bool)
            for i in range(len(names)):
                taken[lists[i]] = True
                rows = np.flatnonzero(taken[cell])
                taken[lists[i]] = False
                score = np.einsum("nd,d->n", x[rows], q[i])
                best = rows[score >= np.partition(score, -(k + 1))[-(k + 1)]] if len(rows) > k + 1 else rows
                value = dict(zip(rows.tolist(), score.tolist()))
                pairs = sorted((-value[r], v) for r in best.tolist() for v in ids[r] if v != names[i])[:k]
                found += [(names[i], v, -s) for s, v in pairs]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    top = located.groupBy("block", "chunk").cogroup(routed.groupBy("block", "chunk")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return top.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
