"""Packing, sharding, chat, neighbours, pieces, Jaccard join and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosswise.llm import catalog, chat, jaccard, neighbours, packing, pieces, sharding, textkit

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no key at all"), (5, "same line again"), (5, "same line again"), (6, "word " * 5000), (7, "é中😀▁ #*"), (8, "a b c d e f"), (9, "\x00</s>")]


# Packing


def unroll(counts, runs):
    """Pieces placed by runs: (length, sequence, offset), and each rank once."""
    ends = defaultdict(list)
    for length, first, *_ in sorted(runs):
        ends[length].append(first)
    out = []
    for length, first, start, k, offset in runs:
        later = [x for x in ends[length] if x > first]
        for j in range((min(later) if later else counts[length]) - first):
            out.append((length, start + j // k, offset + j % k * length))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_without_gaps(seed):
    draw, capacity = random.Random(seed), 60
    counts = Counter(draw.choices(range(1, capacity + 1), k=draw.randint(1, 400), weights=[1 / (k + seed) ** (seed % 3) for k in range(1, capacity + 1)]))
    placed = unroll(counts, packing.plan_runs(counts, capacity))
    assert Counter(p[0] for p in placed) == counts
    bins = defaultdict(list)
    for length, where, offset in placed:
        bins[where].append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    best = max(math.ceil(sum(k * n for k, n in counts.items()) / capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    assert len(bins) <= max(best + 2, 1.2 * best)


def test_small_pieces_take_the_smallest_gap():
    # gaps of 30 and 10 after the large pieces: the piece of 8 belongs into the 10
    placed = unroll({70: 1, 90: 1, 8: 1}, packing.plan_runs({70: 1, 90: 1, 8: 1}, 100))
    where = {length: (b, o) for length, b, o in placed}
    assert where[8] == (where[90][0], 90)


@pytest.mark.parametrize("source", ["odd", "table", "empty"])
def test_packed_pieces_are_the_tokens(spark, frame, source):
    docs = frame(ODD, extra=[("task", "x"), ("piece", "y")]) if source == "odd" else frame([]) if source == "empty" else spark.read.parquet(f"{SF}/documents.parquet")
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(catalog.vocabulary())
    coder.encode_special_tokens = True
    stored, placed = packing.pack(docs, catalog.vocabulary())
    want = Counter()
    for r in docs.collect():
        ids = coder.encode(r.text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(x)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) and sum(n for _, n in x) <= 2048 for x in fill.values())
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(stored).collect()}
    assert sorted(whole.values()) == sorted(sum(n for _, n in x) for x in fill.values())


# Sharding


@pytest.mark.parametrize("source", ["odd", "table", "empty"])
def test_shards_hold_every_row_once(spark, frame, source):
    docs = frame(ODD, extra=[("shard_key", "x"), ("bucket", "y"), ("place", "z")]) if source == "odd" else frame([]) if source == "empty" else spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.external_shuffle(docs, bucket_bytes=20_000)
    rows = got.collect()
    assert set(docs.columns) <= set(got.columns)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shuffle_depends_on_rows_and_seed_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = lambda d, seed: {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(d, seed=seed, bucket_bytes=50_000).collect()}
    one = order(docs, 1)
    assert one == order(docs.repartition(5, "lang"), 1) and one != order(docs, 2)


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(0)
    seen = Counter(tuple(sharding.fisher_yates(4, rng).tolist()) for _ in range(12_000))
    assert len(seen) == 24 and max(abs(n - 500) for n in seen.values()) < 120
    assert sharding.fisher_yates(0, rng).tolist() == [] and sharding.fisher_yates(1, rng).tolist() == [0]


# Chat formatting


def test_best_branches_of_a_tree(spark):
    rows = [("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", "deep", 4.0),
            ("t", 6, 3, "user", "side", 1.0), ("u", 1, 99, "user", "orphan", None), ("u", 7, 8, "user", "cycle", 0.0), ("u", 8, 7, "user", "cycle", 0.0), (None, 1, None, None, None, 2.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    paths = chat.best_paths(nodes, per_tree=2)
    got = defaultdict(list)
    for r in paths.orderBy("position").collect():
        got[r.tree, r.branch_rank].append(r.node)
    # mean scores: 1-3-5 path 9/4, 1-3-6 path 2, 1-2 path 1/2
    assert got == {("t", 1): [1, 3, 4, 5], ("t", 2): [1, 3, 6], ("u", 1): [1], (None, 1): [1]}
    assert chat.format_paths(chat.best_paths(nodes.limit(0))).count() == 0


def test_template_reads_back_and_masks(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<<s>[[INST]", "", None, "é😀 [/INST]\n", "$1 \\1 (.*)", "</s", "[/INST", "x<", " "]
    rows = [(1, k, ["user", "assistant", "sys [INST]\\", None][k % 4], t) for k, t in enumerate(texts)] + [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "user", "b"), (None, 1, "user", "c")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_paths(chat.best_paths(chat.turns_as_chain(chats)))
    got = {r.tree: r for r in done.select("tree", "formatted", "mask", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:13]]
    assert got[1].loss == "".join(t or "" for _, _, r, t in rows[:13] if r == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "b"), ("assistant", "a"), ("assistant", "a")] and got[2].loss == "aa" and got[2].n_turns == 3
    assert got[None].n_turns == 1


def test_conversations_equal_python(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    by[-1] = [(k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in catalog.QUERIES["op3_chat_formatting"](spark, SF).collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# Neighbours


def test_search_finds_the_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    by = defaultdict(list)
    for r in catalog.QUERIES["op8_nearest_neighbours"](spark, SF).collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[:20]
        found = sorted(by.pop(ids[i]))
        assert [f[0] for f in found] == list(range(1, 21)) and all(s == pytest.approx(score[np.flatnonzero(ids == v)[0]]) for _, v, s in found)
        hits += len(set(ids[best]) & {f[1] for f in found})
    assert not by and hits / 20 / sum(ids % 20 == 0) >= 0.9


def test_search_with_odd_vectors_and_copies(spark):
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(60)] + [(100, [2.0, 1.0, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 0.0]), (104, [float("nan"), 1.0, 1.0]),
            (105, [float("inf"), 0.0, 0.0]), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (107, [-0.0, 0.0, -0.0]), (108, []), (20, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100}
    assert got[0] == [(100, 2.0)] + [(k, 1.0) for k in range(1, 20)]
    assert got[100] == [(k, 2.0) for k in range(20)]
    assert got[20] == [(100, 2.0)] + [(k, 1.0) for k in range(19)]
    few = vectors.where("vec_id in (0, 100)")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(few, few).orderBy("query_id").collect()] == [(0, 100), (100, 0)]
    assert neighbours.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pairs_come_in_order_of_distance():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.random(9), rng.random(7), rng.integers(0, 4, 63)
    cells = neighbours.walk_pairs(a, b, sizes, 10**9)
    far = a[cells // 7] + b[cells % 7]
    assert np.all(np.diff(far) >= 0) and sorted(cells) == np.flatnonzero(sizes).tolist()
    assert sizes[neighbours.walk_pairs(a, b, sizes, 20)].sum() >= 20


# SentencePiece


def drawn(texts, keys):
    words = pieces.vocabulary(catalog.vocabulary(catalog.PIECES))
    raw, offs = textkit.buffers(pa.array(texts, pa.string()))
    ids, bounds = pieces.encode(raw, offs, np.array(keys, np.uint64), words)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], pieces.decode(ids, bounds, words), words


def test_sampling_is_lossless_and_independent_of_neighbours():
    draw = random.Random(3)
    alphabet = list("abcdé中 ▁\n\t  the ing😀") + ["▁▁", " the", "\x00"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(400)] + [None, "", " ", "▁", "x" * 3000]
    ids, (data, ends), _ = drawn(texts, range(len(texts)))
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [t or "" for t in texts]
    assert all(drawn([t], [k])[0][0] == i for k, (t, i) in enumerate(zip(texts, ids)) if k % 9 == 0)


def test_sampling_follows_the_weights_of_the_lattice():
    n = 20_000
    ids, _, words = drawn(["the then"] * n, range(1, n + 1))
    seen = Counter(map(tuple, ids))
    text = "▁the▁then"
    known = {b.decode().replace(" ", "▁"): i for i, b in enumerate(words.bytes_of) if words.weight[i] > -np.inf}

    def paths(at):
        if at == len(text):
            yield (), 0.0
        for end in range(at + 1, len(text) + 1):
            if (i := known.get(text[at:end])) is not None:
                for rest, w in paths(end):
                    yield (i, *rest), words.weight[i] + w

    share = {p: math.exp(w) for p, w in paths(0)}
    total = sum(share.values())
    assert set(seen) <= set(share) and len(seen) > 5
    for p, w in share.items():
        q = w / total
        assert abs(seen[p] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 2 / n


def test_piece_frames(spark, frame):
    model = catalog.vocabulary(catalog.PIECES)
    docs = frame(ODD, extra=[("seeded_key", "x"), ("ids", "y")])
    coded = pieces.sample_pieces(docs, model)
    assert coded.columns == [*docs.columns, "pieces"]
    rows = pieces.decode_pieces(coded.select("doc_id", "text", "pieces.ids"), model).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((k, t or "") for k, t in ODD)
    assert len({bytes(r.ids) for r in rows if r.doc_id == 5}) == 1
    again = {(r.doc_id, bytes(r.pieces.ids)) for r in pieces.sample_pieces(docs.repartition(7), model).collect()}
    assert again == {(r.doc_id, bytes(r.ids)) for r in rows}
    assert all(r.lossless for r in catalog.QUERIES["op2_sentencepiece_sampling"](spark, SF).collect())


# Jaccard join


def brute_components(rows, n, percent):
    sets = {}
    for k, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(seed, size=150):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=3)) for _ in range(90)]
    bases = [[draw.choice(words) for _ in range(draw.randint(1, 120))] for _ in range(12)]
    rows = []
    for k in range(size):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            text[draw.randrange(len(text))] = draw.choice(words)
        if draw.random() < 0.2:
            text = bases[0][:40] + text
        rows.append((k, draw.choice([" ", "\n", "  "]).join(w.upper() if draw.random() < 0.1 else w for w in text)))
    return rows


@pytest.mark.parametrize("n, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_components_equal_brute_force(frame, n, percent, seed):
    rows = near_copies(seed)
    want = brute_components(rows, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(rows), n, percent).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_prefix_filter_keeps_every_similar_pair():
    draw = np.random.default_rng(5)
    for _ in range(300):
        base = draw.choice(10**6, draw.integers(1, 60), replace=False)
        x = np.unique(base)
        y = np.unique(np.concatenate([draw.permutation(base)[: max(1, len(base) - draw.integers(0, 5))], draw.integers(0, 10**6, draw.integers(0, 4))]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        need = {id(s): int(jaccard.least_overlap(np.array(len(s)), 80)) for s in (x, y)}
        for k in range(1, min(need.values()) + 1):
            a, b = (s[: len(s) - need[id(s)] + k] for s in (x, y))
            assert len(np.intersect1d(a, b)) >= k


def test_join_with_odd_rows(frame):
    rows = ODD + [(10, "Same LINE\nagain"), (11, "one"), (12, "two words"), (13, "Two\tWords"), (5, "quite another text under the key five"), (14, "quite another text under the key five")]
    got = defaultdict(set)
    for r in jaccard.similar_groups(frame(rows, extra=[("node", "x"), ("component_id", "y")])).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)} and got[None] == {(2, None)}
    assert got[4] == {(1, 4)} and got[11] == {(1, 4)} and got[13] == {(1, 12)} and got[10] == {(1, 5)} and got[14] == {(5, 5)} and got[5] == {(1, 5), (5, 5)}
    assert jaccard.similar_groups(frame([])).count() == 0
    docs = frame(rows, extra=[("node", "x")])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 6, 7, 8, 9, 12])


def test_components_of_long_chains(spark):
    draw = random.Random(8)
    names = list(range(1, 301))
    draw.shuffle(names)
    links = [(a, b) for a, b in zip(names, names[1:])] + [(1000, 1001), (1001, 1000), (1002, 1002)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in names}) == 1 and got[1000] == got[1001] and 1002 not in got


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.cut_lineage(stage(spark, docs, sf))
        sizes.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == columns and docs.exceptAll(before).count() == 0
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {c for _, c in brute_components(rows, 5, 80).values()}
            assert {r.doc_id for r in docs.collect()} == want
            kept = want
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert len(kept & bad) <= 0.05 * len(bad)
