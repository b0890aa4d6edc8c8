"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set are its distinct word shingles. Shingles are ordered from rare to frequent by
a counting sketch over all texts (any fixed order is right; this one keeps frequent
passages out of the prefixes). If two sets are similar enough, their prefixes of length
|x| - t(x) + l, with t the least overlap that similarity demands of x, share at least l
shingles. Every text picks its own l, lengthening its prefix as long as the estimated cost
of candidates falls; a pair needs as many shared prefix shingles as the smaller of its two
l before it is verified on the whole sets.

Equal sets are one node from the start, and shingles count only where texts of compatible
size meet. For the texts left, shingles that no other of them holds are counted on the
whole sets: so many can never be shared. They, and bitmaps of the sets in the last round, bound the
overlap of every pair from above, which keeps near copies that are not near enough from
being emitted and verified pair by pair.

Links are found in rounds: first every text is compared with one pivot of its prefix
shingles (in the first round the text with the fewest shingles of its own), which joins
large groups of near copies at linear cost; then only pairs of texts that no link connects
yet are joined, on the shingles that still meet several components. Verified links are
exact, and pairs left out are connected already or cannot be links, so components are
complete.

Shingles, sets and nodes are 64-bit hashes (see textkit). Defined results: a text without
words (null, empty, blanks) has no shingles and is its own component; rows with a null key
are linked with nothing and get a null component; rows that share a key are connected;
repeated rows share a set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

from . import textkit
from .tasks import free_name, measure_texts

#: Counters of the sketch (a bounded broadcast of one byte each) and bits of the key filter.
SKETCH_BITS, FILTER_BITS = 22, 22
MOST_MATCHES = 8
#: 64-bit words of a set's signature, a bitmap of its hashed shingles.
SIGNATURE = 16
PIVOT_ROUNDS = 2
#: Assumed cost of a candidate against that of reading an entry of a list: moving its set,
#: and comparing it, per shingle.
FETCH, VERIFY = 20.0, 0.05
_BLOCK = 1 << 16


def shingles(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of each text and the texts' ranges; fewer words make one."""
    words = textkit.find_words(raw, offs, textkit.BLANKS)
    count = np.diff(words.first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], np.uint64)
    whole = np.repeat(count >= n, size)
    at = np.repeat(words.first[:-1], size) + np.arange(len(out)) - np.repeat(first[:-1], size)
    out[whole] = textkit.gram_hashes(words.hashes, n)[at[whole]]
    for k in range(1, n):
        short = np.repeat(count == k, size)
        out[short] = textkit.gram_hashes(words.hashes, k)[at[short]] ^ np.uint64(k)
    return out, first


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """Per counter of the sketch, twice the binary logarithm of its count over all texts."""
    texts = docs.select(F.col("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for rows in textkit.slices(batch, 0, 1 << 20):
                found, _ = shingles(*textkit.buffers(rows.column(0)), n)
                np.add.at(total, found >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = np.flatnonzero(total.reshape(-1, _BLOCK).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([pack(total[b * _BLOCK : (b + 1) * _BLOCK].tobytes()) for b in blocks], pa.binary())], ["block", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[block] = totals.get(block, 0) + np.frombuffer(unpack(blob), np.uint32).astype(np.int64)
        classes = [(2 * np.log2(np.maximum(t, 1))).astype(np.uint8).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(classes, pa.binary())], ["block", "counts"])

    schema = "block long, counts binary"
    summed = texts.mapInArrow(count, schema).repartition((1 << SKETCH_BITS) // _BLOCK, "block").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in summed.collect():  # one byte for each counter
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return out


def sorted_sets(raw: np.ndarray, offs: np.ndarray, n: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text from rare to frequent (class above 56 hash bits), and ranges."""
    found, first = shingles(raw, offs, n)
    tokens = (classes[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[first[:-1][first[:-1] < len(tokens)]] = True
    return tokens[new], np.concatenate([[0], np.cumsum(new)])[first]


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of this size must share with any set similar to it."""
    return -(-percent * size // 100)


def set_hashes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each set, from two sums over its members and its size."""
    sums = []
    for mixed in (textkit.mix(tokens << np.uint64(8)), textkit.mix(tokens * textkit._BASE + np.uint64(1))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        sums.append(total[first[1:]] - total[first[:-1]])
    return textkit.mix(textkit.mix(sums[0]) + sums[1] * textkit._BASE + np.diff(first).astype(np.uint64))


def signatures(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SIGNATURE words per set. A bit that one set has and another lacks stands for a
    shingle, at least, that they do not share."""
    out = np.zeros((len(first) - 1) * SIGNATURE, np.uint64)
    bit = (textkit.mix(tokens) >> np.uint64(3)) % np.uint64(64 * SIGNATURE)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.bitwise_or.at(out, owner * SIGNATURE + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def choose_matches(tokens: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Per text, the number of shared prefix shingles with the least estimated cost: reading
    the lists of the prefix, plus verifying the texts that can occur so often in them."""
    size = np.diff(first)
    need = least_overlap(size, percent)
    often = np.concatenate([[0.0], np.cumsum(2.0 ** ((tokens >> np.uint64(56)).astype(np.float64) / 2))])
    best, choice = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for k in range(1, MOST_MATCHES + 1):
        end = first[:-1] + np.maximum(size - need + k, 0)
        entries = often[np.minimum(end, first[1:])] - often[first[:-1]]
        cost = np.where(k <= need, entries * (1 + (FETCH + VERIFY * size) / k), np.inf)
        choice = np.where(cost < best, k, choice)
        best = np.minimum(best, cost)
    return choice


def measured(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """doc_id and, per text: n_shingles, node (64-bit hash of the set, null without words),
    matches and the prefix."""

    def sets(raw: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch) -> list:
        tokens, first = sorted_sets(raw, offs, n, classes)
        size = np.diff(first)
        node = set_hashes(tokens, first)
        matches = choose_matches(tokens, first, percent)
        length = np.where(size > 0, np.minimum(size - least_overlap(size, percent) + matches, size), 0)
        offsets = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(first[:-1], length) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
        prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[at].view(np.int64)))
        return [size, pa.array(node.view(np.int64), mask=size == 0), matches, prefix]

    out = measure_texts(docs, sets, "n_shingles long, node long, matches int, prefix array<long>", "s", carry=["doc_id"], limit=1 << 20)
    return out.select("doc_id", "s.*")


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the hashed keys: at most 2^FILTER_BITS numbers come to the driver. Keys outside
    are certainly not among `keys`."""
    hashed = keys.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit")).distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[hashed.column(0).to_numpy()] = True
    return np.packbits(bits)


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int, classes: np.ndarray) -> DataFrame:
    """(node, members): the sorted set of each wanted (node, doc_id). Only texts whose key
    may be wanted are cut into shingles."""
    bits = key_filter(wanted)
    keyed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            chosen = (bits[bit >> 3] >> (7 - (bit & 7))) & 1
            for rows in textkit.slices(batch.filter(pa.array(chosen.astype(bool))), 1, 1 << 20):
                tokens, first = sorted_sets(*textkit.buffers(rows.column(1)), n, classes)
                members = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tokens.view(np.int64)))
                words = SIGNATURE * np.arange(len(first))
                signs = pa.ListArray.from_arrays(pa.array(words, pa.int32()), pa.array(signatures(tokens, first).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(tokens, first).view(np.int64)), members, signs], ["node", "members", "signature"])

    found = keyed.mapInArrow(run, "node long, members array<long>, signature array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def shared_enough(lists: DataFrame, percent: int) -> DataFrame:
    """Nodes that share enough prefix shingles with texts of compatible size for any link.
    Compatible sizes fall into the same or the next class of a logarithmic scale."""
    scale = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    classed = lists.withColumn("class", scale)
    present = classed.groupBy("token", "class").agg(F.count("*").alias("n"), F.min("matches").alias("least"))
    around = present.select("token", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"), "n", "least")
    near = around.groupBy("token", "class").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n > 1")
    met = classed.join(near, ["token", "class"])
    return met.groupBy("node").agg(F.count("*").alias("n"), F.min(F.least("matches", "least")).alias("least")).where("n >= least").select("node")


def shareable(sets: DataFrame, percent: int) -> DataFrame:
    """(node, most): shingles of each set that some other of the sets holds too, for the
    nodes that have enough of them for any link."""
    members = sets.select("node", F.explode("members").alias("token"))
    single = members.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    sized = sets.select("node", F.size("members").cast("long").alias("size")).join(alone, "node", "left")
    most = sized.select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"))
    return most.where(f"100 * most >= {percent} * size").select("node", "most")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return sized.where(f"100 * both >= {percent} * (sum - both)").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); connected nodes share their root. Nodes
    hook onto their smallest neighbour, pointers are shortened, and the links between what
    remains go into the next round, until there are none."""
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        hook = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        for _ in range(2):
            above = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hook = hook.join(above, "p").select("u", F.col("q").alias("p"))
        hook = cut_lineage(hook)
        moved = hook.select(F.col("u").alias("root"), "p")
        labels = hook.select(F.col("u").alias("node"), F.col("p").alias("root")) if labels is None else labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = cut_lineage(labels)
        a, b = hook.select(F.col("u").alias("a"), F.col("p").alias("pa")), hook.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key of its component)."""
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    classes = frequency_classes(docs, n)
    rows = cut_lineage(measured(docs, n, percent, classes))
    linked = rows.where("doc_id is not null and node is not null")
    nodes = linked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "matches", "prefix"), "doc_id").alias("s"))
    entries = nodes.select("node", F.col("s.n_shingles").alias("size"), F.col("s.matches").alias("matches"), F.explode("s.prefix").alias("token"))
    # Size and matches travel as one number: this is the largest shuffle.
    slim = entries.select("token", "node", (F.col("size") * 16 + F.col("matches")).alias("meta"))
    shared = slim.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    lists = cut_lineage(slim.join(shared, "token").select("token", "node", F.expr("meta div 16").alias("size"), (F.col("meta") % 16).cast("int").alias("matches")))
    hopeful = shared_enough(lists, percent)
    wanted = cut_lineage(linked.join(hopeful, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    sets = cut_lineage(whole_sets(docs, wanted, n, classes))
    lists = cut_lineage(lists.join(shareable(sets, percent), "node"))
    # Rows that share a key are connected.
    keyed = linked.select("doc_id", "node").distinct()
    several = keyed.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = keyed.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    links = cut_lineage(links)
    roots = components(links)
    # Sizes are compatible, and the shingles that may be shared make up enough of both sets.
    near = f"root <> root2 and node <> node2 and {100 + percent} * least(most, most2) >= {percent} * (size + size2)"
    two = ["node2", "root2", "size2", "matches2", "most2"]
    for turn in range(PIVOT_ROUNDS + 1):
        seen = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = F.struct((F.col("size") - F.col("most")) / F.col("size") if turn == 0 else F.lit(0.0), F.xxhash64("node", F.lit(turn)))
        alive = seen.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(order.alias("order"), "node", "root", "size", "matches", "most")).alias("pivot"))
        alive = alive.where("low <> high").drop("low", "high")
        if turn < PIVOT_ROUNDS:
            other = alive.select("token", *[F.col(f"pivot.{c[:-1]}").alias(c) for c in two])
            met = seen.join(other, "token").where(near).groupBy("node", "node2").agg(F.count("*").alias("n"))
            # Each text is compared with the pivot of most of its shingles.
            pairs = met.groupBy("node").agg(F.max_by("node2", F.struct("n", "node2")).alias("node2"))
        else:
            # Words of the signature as columns: the comparison stays in generated code.
            words = [F.coalesce(F.col("signature")[i], F.lit(0)).alias(f"s{i}") for i in range(SIGNATURE)]
            live = cut_lineage(seen.join(alive.select("token"), "token", "left_semi").join(sets.select("node", *words), "node"))
            other = live.select("token", *[F.col(c[:-1]).alias(c) for c in two], *[F.col(f"s{i}").alias(f"t{i}") for i in range(SIGNATURE)])
            own = lambda a, b: " + ".join(f"bit_count({a}{i} & ~{b}{i})" for i in range(SIGNATURE))
            share = f"least(size - ({own('s', 't')}), size2 - ({own('t', 's')}))"
            met = live.join(other, "token").where(f"{near} and node < node2 and {100 + percent} * {share} >= {percent} * (size + size2)")
            pairs = met.groupBy("node", "node2").agg(F.count("*").alias("n"), F.first(F.least("matches", "matches2")).alias("need")).where("n >= need")
        pairs = cut_lineage(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())
        links = cut_lineage(links.union(verified(pairs, sets, percent)))
        roots = components(links)
    smallest = linked.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = smallest.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = smallest.join(ids, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, that of the smallest key, with all its columns; rows with a
    null key all stay."""
    groups = similar_groups(docs, n, percent, text, key)
    keep = groups.where(F.col("component_id") == F.col(f"`{key}`")).select(F.col(f"`{key}`")).distinct()
    chosen = docs.join(keep, key, "left_semi").dropDuplicates([key])
    return chosen.unionByName(docs.where(F.col(f"`{key}`").isNull()))
