import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from crosswise.llm import mixing, negatives, spelling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_hard_negatives"])
def test_queries_match_sql(spark, name):
    report = compare.compare(spark, compare.duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert report.startswith("ok"), report


# --- mixing -------------------------------------------------------------------


def unit_flow(capacity, members, quotas, costs):
    """Total and cost of a cheapest largest flow, one unit at a time over Bellman-Ford paths."""
    patterns, sources = len(capacity), len(quotas)
    start, end, arcs = patterns + sources, patterns + sources + 1, []

    def arc(a, b, room, cost):
        arcs.extend([[a, b, room, cost], [b, a, 0, -cost]])

    for p in range(patterns):
        for cost in costs:
            arc(start, p, capacity[p], cost)
        for s in members[p]:
            arc(p, patterns + s, 1000, 0)
    for s in range(sources):
        arc(patterns + s, end, quotas[s], 0)
    total = cost = 0
    while True:
        far, via = [10**9] * (end + 1), [-1] * (end + 1)
        far[start] = 0
        for _ in range(end + 1):
            for i, (a, b, room, w) in enumerate(arcs):
                if room and far[a] + w < far[b]:
                    far[b], via[b] = far[a] + w, i
        if far[end] == 10**9:
            return total, cost
        at = end
        while at != start:
            arcs[via[at]][2] -= 1
            arcs[via[at] ^ 1][2] += 1
            at = arcs[via[at]][0]
        total, cost = total + 1, cost + far[end]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(4)
    for _ in range(120):
        p, s = rng.randint(1, 5), rng.randint(1, 4)
        capacity, quotas = [rng.randint(0, 6) for _ in range(p)], [rng.randint(0, 9) for _ in range(s)]
        members = [sorted(rng.sample(range(s), rng.randint(0, s))) for _ in range(p)]
        given, routed = mixing.cheapest_flow(capacity, members, quotas)
        cost = sum(w * max(0, min(g - i * c, c)) for g, c in zip(given, capacity) for i, w in enumerate(mixing.REPEAT_COSTS))
        assert all(sum(r.get(i, 0) for r in routed) <= q for i, q in enumerate(quotas))
        assert all(set(r) <= set(m) and g <= 3 * c for r, m, g, c in zip(routed, members, given, capacity))
        assert (sum(given), cost) == unit_flow(capacity, members, quotas, mixing.REPEAT_COSTS)


def test_targets_reshare_what_is_left_over():
    assert mixing.targets(100, [10, 90], [5, 1], 3) == [30, 70]
    assert mixing.targets(30, [10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    assert mixing.targets(0, [0, 0], [5, 2], 3) == [0, 0] and mixing.targets(0, [], [], 3) == []


def test_mix_takes_overlapping_sources(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice([["a"], ["b", "a"], ["b"], ["c", None], [], None])) for i in range(400)]
    rows += [(None, "x y z", ["a"])] * 40 + [(7, "p q", ["c"])] * 25 + [(8, None, ["a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>").repartition(5)
    mixed, shares = mixing.mix(docs.withColumn("size", F.lit("clash")).withColumn("Pattern", F.lit(1)), F.col("members"))
    got, shares = mixed.collect(), shares.collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(3, "text"), F.col("members"))[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert [s["source"] for s in shares] == ["a", "b", "c", None]
    total = sum(len((t or "").split()) for _, t, m in rows if m)
    assert abs(sum(s["target"] for s in shares) - total) < 1e-6
    by_pattern = Counter()
    for r in got:
        assert r["taken"] == 0 if not r["sources"] else r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        by_pattern[tuple(r["sources"])] += r["taken"]
    assert abs(sum(by_pattern.values()) - sum(s["routed"] for s in shares)) <= 30 * len(by_pattern)
    assert sum(r["routed"] for r in shares) >= 0.99 * total


@pytest.mark.parametrize("copies", [1, 600])
def test_mix_of_one_long_text_and_of_repeats(spark, frame, copies):
    docs = frame([(1, "long " * 200_000)] + [(2, "a b c d")] * copies + [(3, "")])
    got = mixing.mix(docs, F.array("source"))[0].groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {1: 200_000, 2: 4 * copies, 3: 0}


def test_mix_of_an_empty_table(spark, frame):
    mixed, shares = mixing.mix(frame([]), F.array("source"))
    assert mixed.count() == 0 and shares.count() == 0


# --- spelling -----------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def runs(text):
    kept = "".join((c.lower() if c.isascii() else c) if c.isascii() and c.isalpha() or "\xc0" <= c <= "\xff" else " " for c in text)
    return [x for x in kept.split(" ") if x]


def expected_variants(rows, damage=None, factor=5, least_count=5):
    n = Counter()
    for key, text in rows:
        for run in runs(text or ""):
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def variants(words):
    got = spelling.variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, got))


def test_variants_match_brute_force(spark, frame, monkeypatch):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(6, 9))) for _ in range(30)]

    def typo(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + ("" if kind == 0 else rng.choice("abcz")) + w[i + (kind < 2) :]

    pool = [w for w in base for _ in range(40)] + [typo(w) for w in base for _ in range(8)] * 6 + [typo(typo(w)) for w in base] * 7
    rng.shuffle(pool)
    rows = [(i, " ".join(pool[i::60]).title() + "-x9, ABCdef") for i in range(60)] + [(None, "abcdefg " * 6), (3, None), (4, ""), (5, "short")]
    docs = frame(rows, extra=[("word", "w"), ("N", "n"), ("range", "r")])
    monkeypatch.setattr(spelling, "RANGE_WORDS", 16)
    for damage in (None, 7):
        assert variants(spelling.word_counts(docs, damage=damage)) == expected_variants(rows, damage)


def test_variants_of_the_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = spelling.word_counts(docs, damage=199)
    rows = [tuple(r) for r in docs.collect()]
    want = expected_variants(rows, 199)
    assert variants(words) == want and len(want) > 500


def test_chains_repeats_and_very_long_texts(spark, frame):
    chain = [("abcdefgh", 5 ** 5), ("abcdefgx", 5 ** 4), ("abcdefyx", 5 ** 3), ("abcdwyx", 7), ("zzzzzzz", 9)]
    text = " ".join(w for w, n in chain for _ in range(n))
    rows = [(1, text), (1, text), (2, "lengthy" * 400_000), (3, "lorem-ipsum dolores " * 60_000)]
    assert variants(spelling.word_counts(frame(rows))) == expected_variants(rows)


def test_no_words(spark, frame):
    for rows in ([], [(1, None), (2, "a b c")]):
        assert variants(spelling.word_counts(frame(rows))) == []


# --- negatives ----------------------------------------------------------------


def expected_negatives(rows, anchor, k=5, m=3):
    whole = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], str(lab)) for i, v, lab in whole]
    out = []
    anchors = {}
    for i, v, lab in sorted(ints, key=lambda r: (r[0], r[2], r[1])):
        if anchor(i):
            anchors.setdefault(i, (v, lab))
    for a, (v, lab) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, u)), i, other) for i, u, other in ints if i != a and len(u) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            fits = [x for x in scored if x[2] != lab and -50 * s <= -100 * x[0] <= -95 * s][:m]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [40, negatives.BLOCK_ROWS])
def test_negatives_match_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6).round(1)], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(400, [0.5] * 6, None), (401, None, 1), (402, [0.5, None] + [0.0] * 4, 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 2), (None, [1.0] * 6, 0), (410, [], 1), (420, [], 1), (430, [], 2)]
    rows += [(440, [2.0, 1.0], 0), (441, [2.0, 1.0], 0), (442, [1.5, 1.0], 1)] + [(450, [0.25] * 6, 1)] * 30 + [rows[0], rows[10]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("block"), F.lit("x").alias("numbers"), F.lit(0).alias("ID"))
    monkeypatch.setattr(negatives, "TILE_ROWS", 64)
    got = negatives.mine_negatives(table, "id % 10 = 0", block_rows=block, chunk_rows=9 if block == 40 else 100)
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())
    assert got == expected_negatives(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_negatives_of_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(50, [1.0], 1)]):
        assert negatives.mine_negatives(spark.createDataFrame(rows, schema), "id % 50 = 0").count() == 0


def test_packed_products_are_exact():
    rng = np.random.default_rng(7)
    for (low, high), d in itertools.product([(-200, 200), (0, 1), (-3, 3), (5, 6), (-(2**24), 2**24), (-(2**29), 2**29)], (1, 3, 16)):
        a, r = rng.integers(low, high, (5, d)), rng.integers(low, high, (9, d))
        assert (negatives.packed_scores(a, r) == a.astype(object) @ r.T.astype(object)).all()
