"""Ranks and group statistics over cross-sections of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from .columns import finite
from .layout import Layout, resolve


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join group-level columns by keys that may be NULL: a NULL group is a group."""
    renamed = groups.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    return df.join(renamed, same, how).drop(*[f"__g_{k}" for k in keys])


def add_group_stats(
    df: DataFrame, keys: Sequence[str], stats: dict[str, str], layout: Layout | None = None
) -> DataFrame:
    """Attach group aggregates to every row of the group; a NULL key is a group.

    `stats` maps a name to SQL in which @ marks each aggregate call, e.g.
    "avg(x) @" or "stddev_pop(x) @".

    Within the task bound this is an unordered window (no second pass over the
    input). Beyond it the input is stored once, the aggregates are combined
    map-side and joined back, so that a hot group is never gathered in one task;
    AQE broadcasts the small side when its measured size allows and splits
    skewed partitions otherwise.
    """
    layout = resolve(layout, df, keys)
    if layout.splits == 1:
        over = f"over (partition by {', '.join(keys)})"
        return df.selectExpr("*", *[f"{sql.replace('@', over)} as {name}" for name, sql in stats.items()])
    stored = cut_lineage(df)
    grouped = stored.groupBy(*keys).agg(*[F.expr(sql.replace("@", "")).alias(name) for name, sql in stats.items()])
    return join_groups(stored, grouped, keys)


def add_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    tie: Sequence[str] = (),
    descending: bool = False,
    position: str | None = None,
    average: str | None = None,
    count: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Rank `value` inside each group; missing and non-finite values take no rank
    position (Spark itself would sort NaN above every number). A NULL key is a group.

    position  1-based place under (value, *tie): a total order
    average   average-tie rank
    count     number of ranked values in the group
    """
    layout = resolve(layout, df, keys)
    keep = df.columns
    if df.schema[value].dataType.simpleString() in ("double", "float"):
        # Values already cleaned keep their column, so that later windows reuse the sort.
        df, ranked = (df, value) if value.startswith("__") else (df.withColumn("__finite", finite(value)), "__finite")
    else:
        ranked = value
    one = _ranks_in_one_task if layout.splits == 1 else _ranks_by_range
    out = one(df, keys, ranked, tie, descending, position, average, count, *([] if layout.splits == 1 else [layout]))
    return out.select(*keep, *[c for c in (position, average, count) if c])


def _ranks_in_one_task(df, keys, value, tie, descending, position, average, count):
    by = ", ".join(keys)
    first = f"{value} {'desc' if descending else 'asc'} nulls last"
    out = df
    if position:
        total = ", ".join([first, *tie])
        out = out.withColumn(
            position,
            F.expr(f"if({value} is null, null, row_number() over (partition by {by} order by {total}))"),
        )
    # Ties are contiguous in the order above, so one more window node gives the
    # first and last place of each tie and the group size without another sort.
    spec = f"partition by {by} order by {first}"
    extras = []
    if average:
        last = f"count({value}) over ({spec} range between unbounded preceding and current row)"
        extras.append(f"if({value} is null, null, (rank() over ({spec}) + {last}) / 2.0D) as {average}")
    if count:
        extras.append(f"count({value}) over ({spec} rows between unbounded preceding and unbounded following) as {count}")
    return out.selectExpr("*", *extras) if extras else out


def _ranks_by_range(df, keys, value, tie, descending, position, average, count, layout):
    """Exact distributed ranks: cut each group into value ranges, rank inside
    the ranges, add the number of rows in the ranges before. The input is stored
    once and the placed rows once, so the plan does not grow when ranks follow
    on ranks; places are 64-bit until the caller's groups are known to be small."""
    keys, keep = list(keys), list(df.columns)
    v = F.col(value)
    ordering = F.struct((-v + 0.0 if descending else v + 0.0).alias("v"), *[F.col(t) for t in tie])
    rows = cut_lineage(df.withColumn("__ord", F.when(v.isNotNull(), ordering)))

    # Split points only steer the work; a poor sample costs balance, not exactness.
    step = 32
    sampled = rows.filter(F.col("__ord").isNotNull() & (F.pmod(F.xxhash64(*keys, "__ord"), F.lit(layout.sample_every)) == 0))
    cuts = (
        sampled.groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__ord")).alias("__sorted"))
        .select(*keys, F.filter("__sorted", lambda x, i: (i % step) == step - 1).alias("__cuts"))
    )
    below: Column = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__ord"))), F.lit(0))
    # Rows without a rank are spread over ranges of their own.
    spread = F.pmod(F.xxhash64(*keep), F.lit(layout.splits)) - layout.splits
    ranged = join_groups(rows, cuts, keys, "left")
    ranged = ranged.withColumn("__range", F.when(F.col("__ord").isNull(), spread).otherwise(F.greatest(below, F.lit(0)))).drop("__cuts")

    sizes = ranged.groupBy(*keys, "__range").agg(F.count("__ord").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "__range",
        "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    local = Window.partitionBy(*keys, "__range").orderBy("__ord")
    numbered = ranged.withColumn("__local", F.row_number().over(local))
    if average:
        tied = Window.partitionBy(*keys, "__range").orderBy("__ord.v")
        numbered = numbered.withColumns({"__lo": F.rank().over(tied), "__hi": F.count("__ord").over(tied.rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = join_groups(numbered, offsets, [*keys, "__range"])
    placed = placed.withColumn("__pos", F.when(F.col("__ord").isNotNull(), F.col("__local") + F.col("__before")))
    extra = {"__v": F.col("__ord.v"), "__edge": (F.col("__lo") == 1) | (F.col("__hi") == F.col("__n")), "__lo": F.col("__lo") + F.col("__before"), "__hi": F.col("__hi") + F.col("__before")}
    placed = placed.withColumns(extra if average else {}).drop("__ord", "__range", "__local", "__before", "__n")
    placed = cut_lineage(placed)
    if average:
        # Ties inside a range are whole there. One that goes on in the next range touches its border:
        # two values a range at most, so no tie, however long, is gathered by its value.
        ends = placed.filter(F.col("__pos").isNotNull() & F.col("__edge")).groupBy(*keys, "__v").agg(F.min("__lo").alias("__from"), F.max("__hi").alias("__to"))
        placed = join_groups(placed, F.broadcast(ends), [*keys, "__v"], "left")
        whole = F.coalesce("__from", "__lo") + F.coalesce("__to", "__hi")
        placed = placed.withColumn("__avg", F.when(F.col("__pos").isNotNull(), whole / 2.0))
    # Positions are INT like row_number's while every group is below 2^31.
    place = F.col("__pos").cast("int") if layout.group_rows < 2**31 else F.col("__pos")
    wanted = [(position, place), (average, F.col("__avg") if average else None), (count, F.col("__total"))]
    return placed.select(*keep, *[c.alias(dst) for dst, c in wanted if dst])


# --- correlation of ranks ------------------------------------------------------

# Ranges cut for each task's worth of rows, and tasks that take the rows of one value that is a cut.
RANGES, SPREAD = 4, 16


def _range_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of each value's range: even between two cuts, odd for the values of one cut."""
    at = np.searchsorted(cuts, x)
    return (2 * at + (np.append(cuts, np.nan)[at] == x)).astype(np.int32)


def _by_value(table: pa.Table, keys: Sequence[str], value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by (group, value), where in it each run of equal ones starts, and which runs open a group."""
    codes = np.zeros(len(table), dtype=np.int64)
    for key in keys:
        own = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        codes = np.unique(codes * len(table) + own, return_inverse=True)[1]
    x = table.column(value).to_numpy()
    order = np.lexsort((x, codes))
    x, codes = x[order], codes[order]
    opens = np.diff(codes, prepend=-1) != 0
    starts = np.flatnonzero(opens | np.append(True, x[1:] != x[:-1]))
    return order, starts, opens[starts]


def _local_ranks(sizes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Average rank of each run, counted inside its group."""
    before = np.cumsum(sizes) - sizes
    return before - before[np.flatnonzero(opens)][np.cumsum(opens) - 1] + (sizes + 1) / 2.0


def rank_correlation(stored: DataFrame, keys: Sequence[str], a: str, b: str, out: str, layout: Layout) -> DataFrame:
    """(keys, `out`): correlation of the average ranks of `a` and `b` in each group, over the rows that hold both,
    exact for groups of any size; missing where one of them is constant. `stored` is read several times.

    Both columns are cut into ranges of a bounded number of rows; a value that many rows share is a
    cut, whose rank follows from the counts of the ranges. Rows meet once by the range of `a`, where
    they get its rank, and leave added up by `b`; those sums meet by the range of `b` and leave
    as one row per group and range. No row is stored, joined back or sorted by its whole group."""
    keys = list(keys)
    rows = stored.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b"))
    kinds = dict(rows.dtypes)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    ranges = RANGES * -(-rows.count() // layout.task_rows)
    points = [i / ranges for i in range(1, ranges)]
    # Cuts only steer the work: a poor one costs balance, not exactness.
    found = rows.agg(*[F.percentile_approx(c, points, max(10_000, 20 * ranges)) for c in ("__a", "__b")]).first() if points else (None, None)
    cuts_a, cuts_b = (np.unique(np.array(c or [], dtype=float)) for c in found)

    def counted(batches):
        for batch in batches:
            for side, column, cuts in (("a", "__a", cuts_a), ("b", "__b", cuts_b)):
                own = pa.table([*batch.select(keys).columns, _range_of(batch.column(column).to_numpy(zero_copy_only=False), cuts)], names=[*keys, "__range"])
                sizes = own.group_by([*keys, "__range"], use_threads=False).aggregate([([], "count_all")])
                columns = [sizes.column(c) for c in (*keys, "__range", "count_all")]
                yield from pa.table([*columns, pa.repeat(side, len(sizes))], names=[*keys, "__range", "__n", "__side"]).to_batches()

    def ranged(batches):
        for batch in batches:
            range_a, range_b = (_range_of(batch.column(c).to_numpy(zero_copy_only=False), cuts) for c, cuts in (("__a", cuts_a), ("__b", cuts_b)))
            # The ranks of a cut's rows are known: they are spread, in the order in which they are read.
            part = np.where(range_a % 2, np.arange(len(range_a)) % SPREAD, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (range_a, range_b, part))], names=[*batch.schema.names, "__ra", "__rb", "__part"])

    placed = rows.mapInArrow(ranged, f"{names}, __a double, __b double, __ra int, __rb int, __part int")
    counts = rows.mapInArrow(counted, f"{names}, __range int, __n bigint, __side string")
    sizes = counts.groupBy(*keys, "__side", "__range").agg(F.sum("__n").alias("__n"))
    side = Window.partitionBy(*keys, "__side")
    earlier = F.coalesce(F.sum("__n").over(side.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.when(F.col("__range") % 2 == 1, (F.col("__n") + 1) / 2.0).otherwise(0.0)
    # Ranks count from the middle of the group, so that sums of products cancel nothing.
    base = earlier + middle - (F.sum("__n").over(side) + 1) / 2.0
    bases = cut_lineage(sizes.select(*keys, "__side", "__range", base.alias("__base")))

    def based(df: DataFrame, side: str, column: str) -> DataFrame:
        own = bases.filter(F.col("__side") == side).drop("__side").withColumnRenamed("__range", column)
        return join_groups(df, own, [*keys, column])

    def rank_a(table: pa.Table) -> pa.Table:
        ranks = table.column("__base").to_numpy().copy()
        if table.column("__ra")[0].as_py() % 2 == 0:
            order, starts, opens = _by_value(table, keys, "__a")
            counts = np.diff(starts, append=len(order))
            ranks[order] += np.repeat(_local_ranks(counts, opens), counts)
        order, starts, _ = _by_value(table, keys, "__b")
        ranks = ranks[order]
        kept = table.select([*keys, "__rb", "__b"]).take(pa.array(order[starts]))
        sums = [np.diff(starts, append=len(order)), np.add.reduceat(ranks, starts), np.add.reduceat(ranks * ranks, starts)]
        return pa.table([*kept.columns, *map(pa.array, sums)], names=[*kept.column_names, "__w", "__s", "__q"])

    def rank_b(table: pa.Table) -> pa.Table:
        order, starts, opens = _by_value(table, keys, "__b")
        w, s, q = (np.add.reduceat(table.column(c).to_numpy()[order], starts) for c in ("__w", "__s", "__q"))
        odd = table.column("__rb")[0].as_py() % 2
        rank = np.zeros(len(w)) if odd else _local_ranks(w, opens)
        groups = np.flatnonzero(opens)
        kept = table.select([*keys, "__rb"]).take(pa.array(order[starts[groups]]))
        sums = [np.add.reduceat(x, groups) for x in (w.astype(float), s, q, s * rank, w * rank, w * rank * rank)]
        return pa.table([*kept.columns, *map(pa.array, sums)], names=[*kept.column_names, "__w", "__s", "__q", "__sl", "__wl", "__wll"])

    ranked = based(placed, "a", "__ra").groupBy("__ra", "__part").applyInArrow(rank_a, f"{names}, __rb int, __b double, __w bigint, __s double, __q double")
    summed = ranked.groupBy("__rb").applyInArrow(rank_b, f"{names}, __rb int, __w double, __s double, __q double, __sl double, __wl double, __wll double")
    total = based(summed, "b", "__rb").groupBy(*keys).agg(
        F.expr("sum(__base * __s + __sl)").alias("__ab"),
        F.expr("sum(__q)").alias("__aa"),
        F.expr("sum(__base * __base * __w + 2 * __base * __wl + __wll)").alias("__bb"),
    )
    return total.select(*keys, F.try_divide(F.col("__ab"), F.sqrt("__aa") * F.sqrt("__bb")).alias(out))
