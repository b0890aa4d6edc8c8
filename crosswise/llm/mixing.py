"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern (the
set of their sources), whose words flow to the sources' quotas: the network has one arc per
pattern and repetition, of the pattern's size and of a cost that grows with every repetition,
one arc from a pattern to each of its sources, and one from a source to its quota. The
cheapest largest flow says how many words a pattern gives, repetitions counted; seeded
documents then make up that number.

Targets: sources in code-point order, null last, take the weights in turn and share all words
in their proportion; a target stops at `most` times its source's size, and what is left over
is shared again by weight among the others. Only sums per pattern come to the driver; their
number is checked against MOST_PATTERNS.

Selection: a pattern that gives q whole rounds and r words more repeats every document q
times and chooses some once more. Documents of more than a thousandth of the pattern, at most a
thousand, are chosen first, as a prefix in seeded order; the rest is a prefix of the others in
seeded order, found over 65,536 buckets of the order and then inside the bucket where the
prefix ends. The chosen words differ from r by half a short document at most, unless the long
ones alone forbid it. Repeated rows are numbered, so that a table of one
row repeated is chosen from like any other.

Defined results: a null text and a text without words have size 0 and are taken 0 words; a
null source is a source of its own, a null or empty set of sources is never taken; null and
repeated keys are rows like others (the order among rows equal in key, sources and size
does not matter); an empty table gives no rows. Other columns are ignored. Reruns agree: the
order is a hash of seed, key and repeat number.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

WEIGHTS = (5, 2, 1)
#: Marginal cost of a pattern's first, second and third use.
REPEAT_COSTS = (0, 1, 3)
MOST_PATTERNS = 20_000
_WORDS = r"[^\x20\x09-\x0D]+"


def targets(total: int, sizes: Sequence[int], weights: Sequence[int], most: int) -> list[Fraction]:
    """Shares of `total` words by weight, none above `most` times its source's size."""
    out: dict[int, Fraction] = {}
    left, free = Fraction(total), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] > most * sizes[i] * weight]
        if not above:
            return [out[i] if i in out else left * weights[i] / weight for i in range(len(sizes))]
        out |= {i: Fraction(most * sizes[i]) for i in above}
        left -= sum(out[i] for i in above)
        free -= set(above)
    return [out[i] for i in range(len(sizes))]


def cheapest_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int] = REPEAT_COSTS) -> tuple[list[int], list[dict[int, int]]]:
    """Words that each pattern gives, and to which sources, in a largest flow of least cost.

    Primal-dual: Dijkstra with potentials finds the next path cost, then all paths of that cost
    are filled. Costs are not negative, and there are few different ones."""
    patterns, sources = len(capacity), len(quotas)
    start, end = patterns + sources, patterns + sources + 1
    arcs: list[list[int]] = []  # to, room, cost; arc ^ 1 is the reverse
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for p in range(patterns):
        for cost in costs:
            arc(start, p, capacity[p], cost)
        for s in members[p]:
            arc(p, patterns + s, len(costs) * capacity[p], 0)
    for s in range(sources):
        arc(patterns + s, end, quotas[s], 0)
    potential = [0] * (end + 1)
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        via, far[start], queue = [-1] * (end + 1), 0, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = arcs[e]
                if room and d + cost + potential[a] - potential[b] < far[b]:
                    far[b], via[b] = d + cost + potential[a] - potential[b], e
                    heapq.heappush(queue, (far[b], b))
        if via[end] < 0:
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, far)]
        turn, dead = [0] * (end + 1), [d == float("inf") for d in far]
        path, at, on_path = [], start, {start}
        while True:
            if at == end:
                room = min(arcs[e][1] for e in path)
                for e in path:
                    arcs[e][1] -= room
                    arcs[e ^ 1][1] += room
                path, at, on_path = [], start, {start}
            elif turn[at] < len(out[at]):
                e = out[at][turn[at]]
                b, room, cost = arcs[e]
                if room and not dead[b] and b not in on_path and cost + potential[at] == potential[b]:
                    path.append(e)
                    at = b
                    on_path.add(b)
                else:
                    turn[at] += 1
            elif at == start:
                break
            else:  # nothing leads on from here in this round
                dead[at] = True
                on_path.discard(at)
                at = arcs[path.pop() ^ 1][0]
    routed = [{arcs[e][0] - patterns: arcs[e ^ 1][1] for e in out[p] if e % 2 == 0 and arcs[e ^ 1][1]} for p in range(patterns)]
    return [sum(r.values()) for r in routed], routed


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, costs: Sequence[int] = REPEAT_COSTS) -> tuple[list[tuple], list[tuple]]:
    """(pattern, size, whole rounds, rest) per pattern and (source, size, target, given) per source, from
    rows (pattern, size)."""
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"More than {MOST_PATTERNS} membership patterns: merge sources")
    sets = [json.loads(r["pattern"]) for r in rows]
    names = sorted({n for s in sets for n in s}, key=lambda n: (n is None, n or ""))
    number = {n: i for i, n in enumerate(names)}
    sizes = [0] * len(names)
    for r, s in zip(rows, sets):
        for n in s:
            sizes[number[n]] += r["size"]
    total = sum(r["size"] for r, s in zip(rows, sets) if s)
    turn = [weights[i % len(weights)] for i in range(len(names))]
    exact = targets(total, sizes, turn, len(costs))
    quotas = [int(t + Fraction(1, 2)) for t in exact]
    given, routed = cheapest_flow([r["size"] for r in rows], [[number[n] for n in s] for s in sets], quotas, costs)
    patterns = [(r["pattern"], r["size"], *(divmod(g, r["size"]) if r["size"] else (0, 0))) for r, g in zip(rows, given)]
    got = [sum(r.get(i, 0) for r in routed) for i in range(len(names))]
    return patterns, list(zip(names, sizes, [float(t) for t in exact], got))


def numbered(rows: DataFrame) -> DataFrame:
    """The stored rows with `again`: 0, 1, ... among rows equal in key, pattern and size. Ranks
    inside a stored file's split plus sums over the splits, for repeated rows only."""
    same = ["key", "pattern", "size"]
    alike = "a.key <=> b.key and a.pattern = b.pattern and a.size = b.size"
    many = rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").drop("n").alias("b")
    placed = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)).alias("a")
    single = placed.join(many, F.expr(alike), "left_anti").withColumn("again", F.lit(0).cast("long"))
    repeated = placed.join(many, F.expr(alike), "left_semi")
    before = repeated.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = before.select(*same, "part", (F.sum("n").over(Window.partitionBy(*same).orderBy("part")) - F.col("n")).alias("before")).alias("b")
    local = repeated.withColumn("rank", F.row_number().over(Window.partitionBy(*same, "part").orderBy("place")) - 1).alias("a")
    again = local.join(before, F.expr(f"{alike} and a.part = b.part")).select("a.*", (F.col("rank") + F.col("before")).alias("again"))
    return single.unionByName(again.drop("rank")).drop("place", "part")


def order_hash(seed: str) -> Column:
    """60 bits of an MD5 of seed, key and repeat number."""
    name = F.concat_ws("|", F.lit(seed), F.coalesce("key", F.lit("")), F.col("again").cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def choose_rest(rows: DataFrame) -> DataFrame:
    """Rows (key, pattern, size, again, h, total, rest, ...) with `extra`: whether the row is among
    those that make up its pattern's rest."""
    names = rows.columns
    rows = rows.withColumn("is_long", F.col("size") * 1000 > F.col("total"))
    by = Window.partitionBy("pattern").orderBy("h", "key", "size", "again")
    longs = rows.where("is_long").select(*names, F.sum("size").over(by).alias("upto"), F.sum("size").over(Window.partitionBy("pattern")).alias("of_long"))
    # The prefix of the long ones whose remainder the short ones can make up, nearest to a proportional share.
    cuts = longs.select("pattern", "total", "rest", "of_long", F.explode(F.array(F.lit(0).cast("long"), F.col("upto"))).alias("cut"))
    miss = F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("cut") - (F.col("total") - F.col("of_long")), F.col("cut") - F.col("rest"))
    off = F.abs(F.col("cut") - F.col("rest") * F.col("of_long") / F.col("total"))
    cuts = cuts.groupBy("pattern").agg(F.min(F.struct(miss.alias("miss"), off.alias("off"), "cut"))["cut"].alias("cut"))
    longs = longs.join(F.broadcast(cuts), "pattern").select(*names, (F.col("upto") <= F.col("cut")).alias("extra"))
    short = rows.where("not is_long").join(F.broadcast(cuts), "pattern", "left")
    short = short.select(*names, (F.col("rest") - F.coalesce("cut", F.lit(0))).alias("want"), F.shiftright("h", 44).alias("bucket"))
    sums = short.groupBy("pattern", "bucket").agg(F.sum("size").alias("here"), F.max("want").alias("want"))
    sums = sums.withColumn("below", F.sum("here").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("here"))
    ends = sums.groupBy("pattern").agg(
        F.max(F.when(F.expr("below + here <= want"), F.col("bucket"))).alias("last"),
        F.max(F.when(F.expr("below < want and want < below + here"), F.struct("bucket", "below"))).alias("edge"))
    marked = short.join(F.broadcast(ends), "pattern")
    clear = marked.where("edge is null or bucket <> edge.bucket").select(*names, F.coalesce(F.col("bucket") <= F.col("last"), F.lit(False)).alias("extra"))
    inside = marked.where("bucket = edge.bucket").withColumn("upto", F.col("edge.below") + F.sum("size").over(by))
    # The document at the end counts if its middle is not beyond it.
    at_edge = inside.select(*names, (F.col("upto") - F.col("size") / 2 <= F.col("want")).alias("extra"))
    return longs.unionByName(clear).unionByName(at_edge)


def mix(docs: DataFrame, sources: Column, seed: str = "mix", weights: Sequence[int] = WEIGHTS, costs: Sequence[int] = REPEAT_COSTS,
        text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents as (key, sources, size, taken), and the sources as (source, source_size, target, routed).

    `sources` is an array of source names of each document."""
    members = F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(_WORDS)), F.lit(0)).cast("long")
    own = F.col(f"`{key}`")
    sized = cut_lineage(docs.select(own.alias("own"), own.cast("string").alias("key"), F.to_json(members).alias("pattern"), size.alias("size")))
    patterns, shares = plan(sized, weights, costs)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(patterns, "pattern string, total long, rounds long, rest long"))  # MOST_PATTERNS rows at most
    planned = "size > 0 and rest > 0"
    rows = sized.join(table, "pattern")
    open_ = choose_rest(numbered(cut_lineage(rows.where(planned))).withColumn("h", order_hash(seed)))
    taken = open_.select("own", "pattern", "size", "rounds", "extra").unionByName(
        rows.where(f"not ({planned})").select("own", "pattern", "size", "rounds", F.lit(False).alias("extra")))
    times = F.col("rounds") + F.col("extra").cast("int")
    mixed = taken.select(F.col("own").alias(key), F.from_json("pattern", "array<string>").alias("sources"), "size", (F.col("size") * times).alias("taken"))
    return mixed, spark.createDataFrame(shares, "source string, source_size long, target double, routed long")
