"""Hard-negative mining with Kronecker-packed products.

Components become integers, floor(scale * x). To score many rows at once, the same component
of several rows is biased to be non-negative and laid into separate bit fields of one wide
integer; one multiplication by a (biased) anchor component multiplies every field, sums over
the components stay inside their fields, whose width holds the largest possible sum, and the
unpacked fields minus the share of the biases are exact inner products. Fields fill 64-bit
words while their width allows it; vectors too large for that use Python's wide integers.

Anchors meet all rows in tiles: rows are dealt into blocks and anchors into chunks of bounded
size, and a task scores one chunk against one block, a few hundred anchors at a time. A first
pass over rows of the anchor's label finds its positives, a second one over the other rows
the negatives inside the band of each positive; every tile returns only its best, which a
window by anchor merges.

Defined results: a row takes no part if its key or label is null, or its vector is null or
holds null, NaN or infinite components; vectors meet only vectors of their own length (two
empty ones score 0). Anchors that share a key count once, as the smallest (label, vector);
other repeated rows take part one by one, and rows with the anchor's key are never its
positives or negatives. Empty tables give no rows; other columns are ignored. Scores that
leave 64 bits end the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

#: Bounds of a task: rows of a block and anchors of a chunk, and the anchors and rows scored at once.
BLOCK_ROWS, CHUNK_ROWS = 32768, 65536
TILE_ANCHORS, TILE_ROWS = 128, 2048
#: Fields of one wide Python integer, where 64-bit words cannot hold a single field.
WIDE_FIELDS = 16


def pack(rows: np.ndarray, width: int, fields: int) -> np.ndarray:
    """(components, words): word w holds one component of rows w * fields + k in the bits from k * width."""
    padded = np.zeros((-(-len(rows) // fields) * fields, rows.shape[1]), rows.dtype)
    padded[: len(rows)] = rows
    grouped = padded.reshape(-1, fields, rows.shape[1])
    words = grouped[:, 0].copy()
    for k in range(1, fields):
        words |= grouped[:, k] << words.dtype.type(k * width) if words.dtype != object else grouped[:, k] << (k * width)
    return np.ascontiguousarray(words.T)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of two int64 matrices with equally many components."""
    d = rows.shape[1]
    if not len(anchors) or not len(rows) or not d:
        return np.zeros((len(anchors), len(rows)), np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    most = d * (int(anchors.max()) - low_a) * (int(rows.max()) - low_r)
    width = max(most.bit_length(), 1)
    fields, kind = (64 // width, np.uint64) if width <= 64 else (WIDE_FIELDS, object)
    if kind is object:
        a, r = anchors.astype(object) - low_a, rows.astype(object) - low_r
        shift, mask = [k * width for k in range(fields)], (1 << width) - 1
    else:
        a, r = (anchors - low_a).astype(np.uint64), (rows - low_r).astype(np.uint64)
        shift, mask = [np.uint64(k * width) for k in range(fields)], np.uint64((1 << width) - 1)
    words = pack(r, width, fields)
    total, product = np.zeros((len(a), words.shape[1]), kind), np.empty((len(a), words.shape[1]), kind)
    for j in range(d):
        np.multiply(a[:, j, None], words[j], out=product)
        np.add(total, product, out=total)
    # sum (x - low_a)(y - low_r) = xy - low_r * sum x - low_a * sum y + d * low_a * low_r
    of_rows = rows.astype(kind if kind is object else np.int64).sum(axis=1) * low_a - d * low_a * low_r
    of_anchors = anchors.astype(kind if kind is object else np.int64).sum(axis=1) * low_r
    out = np.empty((len(a), words.shape[1] * fields), np.int64 if kind is not object else object)
    for k in range(fields):
        out[:, k::fields] = (total >> shift[k]) & mask
    out = out[:, : len(rows)] + of_rows[None, :] + of_anchors[:, None]
    return out.astype(np.int64)


def _matrices(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts and flat values of a column of integer lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), offsets[:-1], lists.values.to_numpy()


def _tiles(anchors: pa.Table, rows: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor places, row places, scores) of every tile of equal vector lengths: with `same`,
    rows of the anchors' label only, otherwise all rows."""
    codes = np.unique(np.concatenate([t.column("label").to_numpy(zero_copy_only=False).astype(str) for t in (anchors, rows)]), return_inverse=True)[1]
    of_anchor, of_row = codes[: anchors.num_rows], codes[anchors.num_rows :]
    size_a, start_a, values_a = _matrices(anchors.column("numbers"))
    size_r, start_r, values_r = _matrices(rows.column("numbers"))
    key_a = np.stack([size_a, of_anchor if same else np.zeros_like(of_anchor)])
    key_r = np.stack([size_r, of_row if same else np.zeros_like(of_row)])
    for d, c in np.unique(key_a, axis=1).T.tolist():
        mine, theirs = (np.flatnonzero((k[0] == d) & (k[1] == c)) for k in (key_a, key_r))
        for r in range(0, len(theirs), TILE_ROWS):
            at_r = theirs[r : r + TILE_ROWS]
            right = values_r[start_r[at_r, None] + np.arange(d)]
            for a in range(0, len(mine), TILE_ANCHORS):
                at_a = mine[a : a + TILE_ANCHORS]
                yield at_a, at_r, packed_scores(values_a[start_a[at_a, None] + np.arange(d)], right)


def _firsts(owner: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each owner: highest score, then smallest key."""
    order = np.lexsort((key, -score, owner))
    owner = owner[order]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    return order[rank < k]


def _best_positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids_a, ids_r = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        for at_a, at_r, scores in _tiles(anchors, rows, same=True) if anchors.num_rows and rows.num_rows else ():
            a, r = np.nonzero(ids_a[at_a, None] != ids_r[None, at_r])
            s = scores[a, r]
            best = _firsts(a, s, ids_r[at_r[r]], k)
            found.append((ids_a[at_a[a[best]]], ids_r[at_r[r[best]]], s[best]))
        columns = [np.concatenate(x) for x in zip(*found)]
        best = _firsts(columns[0], columns[2], columns[1], k)
        return pa.table([c[best] for c in columns], ["anchor_id", "positive_id", "positive_score"])

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids_a, ids_r = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
        labels_a, labels_r = (t.column("label").to_numpy(zero_copy_only=False).astype(str) for t in (anchors, rows))
        count, start, positive = _matrices(anchors.column("positive_score"))
        positive_ids = _matrices(anchors.column("positive_id"))[2]
        found = [(np.zeros(0, np.int64),) * 4]
        for at_a, at_r, scores in _tiles(anchors, rows, same=False) if anchors.num_rows and rows.num_rows else ():
            # Band of each anchor's slots; an anchor with fewer positives has empty bands.
            slots = int(count[at_a].max(initial=0))
            least, most = np.ones((slots, len(at_a)), np.int64), np.zeros((slots, len(at_a)), np.int64)
            for slot in range(slots):
                has = count[at_a] > slot
                p = positive[start[at_a[has]] + slot]
                least[slot, has], most[slot, has] = -(-low * p // 100), high * p // 100
            open_ = least <= most
            lowest = np.where(open_, least, np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            highest = np.where(open_, most, np.iinfo(np.int64).min).max(axis=0, initial=np.iinfo(np.int64).min)
            a, r = np.nonzero((scores >= lowest[:, None]) & (scores <= highest[:, None]))
            other = (labels_a[at_a[a]] != labels_r[at_r[r]]) & (ids_a[at_a[a]] != ids_r[at_r[r]])
            a, r = a[other], r[other]
            s = scores[a, r]
            for slot in range(slots):
                inside = np.flatnonzero((s >= least[slot, a]) & (s <= most[slot, a]))
                best = inside[_firsts(a[inside], s[inside], ids_r[at_r[r[inside]]], k)]
                found.append((at_a[a[best]], np.full(len(best), slot), ids_r[at_r[r[best]]], s[best]))
        owner, slot, negative, s = (np.concatenate(x) for x in zip(*found))
        best = _firsts(owner * (1 + int(count.max(initial=0))) + slot, s, negative, k)
        owner, slot, negative, s = owner[best], slot[best], negative[best], s[best]
        at = start[owner] + slot if len(owner) else owner
        return pa.table([ids_a[owner], slot.astype(np.int32), positive_ids[at], positive[at], negative, s],
                        ["anchor_id", "slot", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """(id, label, numbers) of the rows that take part."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    return rows.select("id", "label", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("numbers"))


def mine_negatives(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` is an SQL condition on `id` that picks the anchors. Negatives are the first rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    stored = cut_lineage(usable(vectors, key, vector, label, scale))
    n = stored.count()
    blocks = -(-n // min(max(n // 64, 1024), block_rows)) or 1
    # Rows of a stored table have fixed places, so repeated rows are dealt over blocks like others.
    dealt = stored.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    chosen = cut_lineage(stored.where(anchors).groupBy("id").agg(F.min(F.struct("label", "numbers")).alias("s")).select("id", "s.*"))
    chunks = -(-chosen.count() // chunk_rows) or 1
    rows = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def tiled(heads: DataFrame, fn, schema: str) -> DataFrame:
        left = heads.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).select("*", every).withColumn("block", F.col("block").cast("long"))
        return left.groupBy("chunk", "block").cogroup(rows.groupBy("chunk", "block")).applyInArrow(fn, schema)

    near = tiled(chosen, _best_positives(positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("place", place).where(f"place <= {int(positives)}")
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    heads = chosen.join(lists, F.col("anchor_id") == F.col("id")).select("id", "label", "numbers", F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score"))
    far = tiled(cut_lineage(heads), _best_negatives(negatives, low, high), "anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", rank).where(f"rank <= {int(negatives)}").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
