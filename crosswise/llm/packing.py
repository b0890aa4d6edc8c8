"""Best-fit packing of documents into sequences of at most `capacity` tokens.

Pieces longer than a third of the capacity are matched greedily, longest first, each with
the longest partner that still fits, so a sequence holds two of them at most. Shorter
pieces then go, longest first, into the smallest gap that takes them.

Whether a piece fits depends on its length alone, so the plan is made over the counts of
the lengths (at most `capacity` numbers, whatever the corpus) and is a table of runs:
"the next m * k pieces of length s fill m sequences from b on, k in each, from offset o".
Pieces find their run by their rank among the pieces of their length; the rank is the
rank inside the task that wrote the piece plus a prefix sum over tasks. No group is ever
gathered, and hot lengths cost nothing extra.

Defined results: a null or empty text is a document of one token (the closing id); equal
or repeated documents are placed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crosswise.sources.storage import cut_lineage

from . import bpe, textkit

CAPACITY = 2048
END_ID = 0


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids (little-endian unsigned 32-bit),
    and the writing task with the piece's rank among its pieces of that length. Only texts
    of more than `capacity` tokens are cut, into full pieces behind a shorter first one."""
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = "piece int, start long, length long, ids binary, task int, rank long"
    out = T.StructType([source.schema.fields[0], *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tokens = bpe.encoder(vocabulary)
        for batch in batches:
            for rows in textkit.slices(batch, 1, 1 << 20):
                raw, offs = textkit.buffers(rows.column(1))
                ids, bounds = tokens.encode(raw, offs)
                size = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], END_ID)  # the closing id of every document
                begin = np.cumsum(size) - size
                pieces = -(-size // capacity)
                first = size - (pieces - 1) * capacity
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                head = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1]) if len(order) else np.zeros(0, np.int64)
                runs = np.diff(np.append(head, len(order)))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(head, runs) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                data = ids.astype("<u4").tobytes()
                at = 4 * (begin[doc] + start)
                blobs = pa.array([data[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)).cast(arrow.field(0).type), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), blobs, pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)],
                    schema=arrow,
                )

    return source.mapInArrow(run, out)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset) that place
    every piece; a run ends where the next one of its length begins."""
    left = dict(counts)
    used: dict[int, int] = defaultdict(int)
    gaps: list[int] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def place(length: int, first: int, m: int, k: int, offset: int, last: int | None = None) -> None:
        runs.append((length, used[length], first, k, offset))
        used[length] += m * k if last is None else last

    def release(gap: int, first: int, m: int) -> None:
        if gap and m:
            if not free[gap]:
                bisect.insort(gaps, gap)
            free[gap].append((first, m))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    upward = large[::-1]
    for a in large:
        while left[a]:
            at = bisect.bisect_right(upward, min(a, capacity - a)) - 1
            while at >= 0 and left[upward[at]] < 1 + (upward[at] == a):
                if left[upward[at]] == 0:
                    upward.pop(at)
                at -= 1
            if at < 0:
                m, k, rest = left[a], 1, capacity - a
                place(a, bins, m, 1, 0)
            elif (b := upward[at]) == a:
                m, k, rest = left[a] // 2, 2, capacity - 2 * a
                place(a, bins, m, 2, 0)
            else:
                m, k, rest = min(left[a], left[b]), 1, capacity - a - b
                place(a, bins, m, 1, 0)
                place(b, bins, m, 1, a)
                left[b] -= m
            left[a] -= m * k
            release(rest, bins, m)
            bins += m
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                m = -(-left[s] // (capacity // s))
                release(capacity, bins, m)
                bins += m
                continue
            gap = gaps[at]
            first, m = free[gap].pop()
            if not free[gap]:
                gaps.pop(at)
            k = gap // s
            full = min(m, left[s] // k)
            if full:
                place(s, first, full, k, capacity - gap)
                left[s] -= full * k
                release(gap - k * s, first, full)
            if full < m and left[s]:  # fewer than k are left: they share one sequence
                n = left[s]
                place(s, first + full, 1, n, capacity - gap)
                left[s] = 0
                release(gap - n * s, first + full, 1)
                full += 1
            release(gap, first + full, m - full)
    return runs


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of the pieces (task and rank replaced) with sequence_id and offset.
    `pieces` must be stored: it is read twice."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan_runs(totals, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("task", "base")
    kept = [c for c in ranked.columns if c != "rank"]
    out = T.StructType([*ranked.select(*kept).schema.fields, *T._parse_datatype_string("sequence_id long, offset long").fields])
    arrow = to_arrow_schema(out)
    table = np.array(runs, np.int64).reshape(-1, 5)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.int64(50)  # lengths stay far below 2^13, ranks below 2^50
        starts = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length * shift + rank, "right") - 1
            _, first_rank, first_bin, per_bin, offset = table[at].T
            j = rank - first_rank
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            found = [pa.array(first_bin + j // per_bin), pa.array(offset + j % per_bin * length)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow)), *found], schema=arrow)

    return ranked.select(*kept, "rank").mapInArrow(run, out)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Stored pieces with their ids, and the placement of every piece with the crc32 of its ids."""
    stored = cut_lineage(token_pieces(docs, vocabulary, capacity, text, key))
    digest = stored.select(F.col(f"`{key}`"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "rank")
    return stored, place_pieces(digest, capacity)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences of stored pieces: sequence_id and its ids (unsigned 32-bit,
    little-endian). A sequence holds `capacity` ids at most, so no group is large."""
    placed = place_pieces(pieces.select("length", "ids", "task", "rank"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
