"""Staged hyperparameter search over tables of candidates.

A candidate is a row, a stage is one plan over all candidates of all groups (an as-of date, a
year), and what a stage learns reaches the next by joins. Evaluation is a function from
candidate rows to result rows, so any learner that Spark can fit for many candidates at once
takes part; `blend_path_results` is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import Layout
from ..sources.storage import cut_lineage
from .portfolio import MIN_UNIVERSE, SELECTION_BPS, cost_scenarios, long_short_weekly
from .windows import choose_candidate

RESULTS = ["information_ratio", "cumulative_return", "complexity", "median_iterations", "max_iterations"]


def with_params(table: DataFrame, changed: Mapping[str, str]) -> DataFrame:
    """`params` with the values of `changed` in place of its own."""
    names = [F.lit(n) for n in changed]
    rest = F.map_filter("params", lambda name, _: ~name.isin(*names))
    new = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
    return table.withColumn("params", F.map_concat(rest, new))


def staged_search(
    candidates: DataFrame, evaluate: Callable[[DataFrame], DataFrame], keys: Sequence[str], *,
    truncation: str, refinement: Mapping[str, str], threshold: float = 0.9,
) -> DataFrame:
    """W10 for every group of `keys` at once.

    1. All of `candidates` (keys..., position, candidate, params map<string,string>).
    2. The two best of them again under `truncation`, unless that is what they had.
    3. The best so far again with the parameters of `refinement`, but only if the median of its
       iterations reaches `threshold` of its ceiling `n_estimators`, or one fold reaches all of it.

    `evaluate` returns (keys..., candidate, *RESULTS) for candidate rows; a candidate without a
    result takes no part, and a group with one candidate has one finalist. The choice is
    `choose_candidate` in order of position, later stages last. Returns every evaluated
    candidate with its stage, `refined` (stage 3 took place) and `selected`."""
    keys = list(keys)
    same = [*keys, "candidate"]

    def judged(table: DataFrame, stage: int) -> DataFrame:
        stored = cut_lineage(table.select(*keys, "position", "candidate", "params"))
        results = evaluate(stored).select(*same, *RESULTS)
        return cut_lineage(stored.join(results, same).withColumn("stage", F.lit(stage)))

    def best(table: DataFrame) -> DataFrame:
        return choose_candidate(table.select(*same, "position", *RESULTS[:3]), keys).select(*same)

    one = judged(candidates, 1)
    first = cut_lineage(best(one))
    second = best(one.join(first, same, "left_anti"))
    finalists = first.withColumn("finalist", F.lit(1)).unionByName(second.withColumn("finalist", F.lit(2)))
    last = candidates.groupBy(*keys).agg(F.max("position").alias("last"))
    again = one.join(finalists, same).join(last, keys).filter(~F.try_element_at("params", F.lit("truncation")).eqNullSafe(F.lit(truncation)))
    again = again.withColumn("position", F.col("last") + F.col("finalist")).withColumn("candidate", F.concat(F.lit("finalist "), "finalist"))
    two = judged(with_params(again, {"truncation": truncation}), 2)
    both = one.unionByName(two)
    leader = both.join(best(both), same)
    ceiling = F.col("params")["n_estimators"].cast("int")
    late = (F.col("median_iterations") >= F.ceil(F.lit(threshold) * ceiling)) | (F.col("max_iterations") >= ceiling)
    refined = leader.filter(late).join(last, keys).withColumn("position", F.col("last") + 3).withColumn("candidate", F.lit("refined"))
    three = judged(with_params(refined, refinement), 3)
    every = both.unionByName(three)
    won = best(every).withColumn("selected", F.lit(True))
    told = three.select(*keys, F.lit(True).alias("refined"))
    out = every.join(told, keys, "left").join(won, same, "left")
    return out.withColumns({"refined": F.coalesce("refined", F.lit(False)), "selected": F.coalesce("selected", F.lit(False))})


def path_edges(rows: DataFrame, points: Sequence[tuple], active: str) -> DataFrame:
    """The `truncation` best and worst names of every candidate and iteration, per batch of rows.

    rows: (cell..., ticker, base, added, `active`), a cell's rows together and by ticker; points:
    (keys..., candidate, learning_rate, truncation, n_estimators). Returns (cell..., candidate, t,
    truncation, ticker, score, `active`, n): n is the batch's scored names of the cell, on one of its
    rows. Names that are an edge of a cell are edges of their batch, and a batch gives
    at most 2 * truncation rows a cell, candidate and iteration, so no path is ever written out."""
    cell = [c for c in rows.columns if c not in ("ticker", "base", "added", active)]
    keys = [c for c in cell if c not in ("fold", "week_date")]
    of_key: dict[tuple, list] = {}
    for *key, candidate, rate, truncation, ceiling in points:
        of_key.setdefault(tuple(key), []).append((candidate, rate, truncation, ceiling))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in cell]
            changed = np.any([np.diff(p) != 0 for p in places], axis=0)
            bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            base, added = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("base", "added"))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                took, candidates, iterations, truncations, scores, counts = [], [], [], [], [], []
                for candidate, rate, truncation, ceiling in of_key.get(tuple(batch.column(c)[lo].as_py() for c in keys), []):
                    for t in range(1, ceiling + 1):
                        share = t * rate
                        with np.errstate(invalid="ignore"):
                            score = base[lo:hi] * (1 - share) + added[lo:hi] * share
                        known = np.flatnonzero(np.isfinite(score))
                        order = known[np.argsort(-score[known], kind="stable")]
                        edge = order if len(order) <= 2 * truncation else np.concatenate([order[:truncation], order[-truncation:]])
                        took.append(edge + lo)
                        scores.append(score[edge])
                        candidates += [candidate] * len(edge)
                        iterations += [t] * len(edge)
                        truncations += [truncation] * len(edge)
                        counts += [len(order), *[0] * (len(edge) - 1)][: len(edge)]
                if not candidates:
                    continue
                picked = batch.take(pa.array(np.concatenate(took)))
                own = [pa.array(candidates, pa.string()), pa.array(iterations, pa.int32()), pa.array(truncations, pa.int32())]
                columns = [*[picked.column(c) for c in cell], *own, picked.column("ticker"), pa.array(np.concatenate(scores)), picked.column(active), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*cell, "candidate", "t", "truncation", "ticker", "score", active, "n"])

    kinds = dict(rows.dtypes)
    schema = [*[(c, kinds[c]) for c in cell], ("candidate", "string"), ("t", "int"), ("truncation", "int"), ("ticker", kinds["ticker"]),
              ("score", "double"), (active, kinds[active]), ("n", "bigint")]
    return rows.mapInArrow(edges, ", ".join(f"`{c}` {kind}" for c, kind in schema))


def blend_path_results(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], layout: Layout, active: str = "raw_active_return") -> DataFrame:
    """Results of an additive path from one signal to another.

    rows: (keys..., fold, ticker, week_date, base, added, `active`); params: learning_rate,
    truncation, n_estimators. After t iterations a row scores
    base * (1 - t * rate) + added * t * rate. A fold stops where the spread between its
    `truncation` best and worst names is largest on average (the fewest iterations of equal
    ones); the folds, each at its own number of iterations, are stitched and judged as a
    long/short book net of costs. Simpler: smaller truncation, then fewer iterations.

    Rows meet by week in one exchange and are multiplied only inside its tasks: for the paths as
    edges (`path_edges`), for the chosen iteration by the candidates of the parameter table."""
    keys = list(keys)
    same = [*keys, "candidate"]
    point = candidates.select(*same, *[F.col("params")[n].cast(t).alias(n) for n, t in
                                       (("learning_rate", "double"), ("truncation", "int"), ("n_estimators", "int"))])
    share = F.col("t") * F.col("learning_rate")
    score = F.col("base") * (1 - share) + F.col("added") * share
    week = [*same, "t", "fold", "truncation", "week_date"]
    rows = rows.select(*keys, "fold", "week_date", "ticker", "base", "added", active).repartition(*keys, "week_date")
    points = [tuple(p) for p in point.select(*same, "learning_rate", "truncation", "n_estimators").collect()]
    edges = path_edges(rows.sortWithinPartitions(*keys, "week_date", "fold", "ticker"), points, active)
    cell = Window.partitionBy(*week)
    placed = edges.select(
        "*", F.sum("n").over(cell).alias("names"), F.row_number().over(cell.orderBy(F.col("score").desc(), "ticker")).alias("best"),
        F.row_number().over(cell.orderBy("score", F.col("ticker").desc())).alias("worst"))
    top = F.avg(F.when(F.col("best") <= F.col("truncation"), F.col(active)))
    bottom = F.avg(F.when(F.col("worst") <= F.col("truncation"), F.col(active)))
    spreads = placed.filter(F.col("names") >= MIN_UNIVERSE).groupBy(*week).agg((top - bottom).alias("spread"))
    # Rounded, so that equal spreads are equal whatever the order of addition.
    losses = spreads.groupBy(*same, "fold", "t").agg(F.round(F.avg("spread"), 9).alias("spread"))
    stopped = cut_lineage(losses.groupBy(*same, "fold").agg(F.max_by(F.col("t"), F.struct("spread", -F.col("t"))).alias("t")))
    at = stopped.join(point, same)
    stitched = rows.join(F.broadcast(at), [*keys, "fold"]).withColumn("score", score)
    weekly = long_short_weekly(stitched, same, active=active, layout=layout).filter("gross_return is not null")
    net = cost_scenarios(weekly, same, [SELECTION_BPS]).select(*same, "information_ratio", "cumulative_return")
    iterations = stopped.groupBy(*same).agg(F.expr("cast(median(t) as double)").alias("median_iterations"), F.max("t").alias("max_iterations"))
    simple = F.array(F.col("truncation").cast("double"), F.col("median_iterations"))
    return net.join(iterations, same).join(point, same).withColumn("complexity", simple).select(*same, *RESULTS)
