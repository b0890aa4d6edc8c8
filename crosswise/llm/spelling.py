"""Spelling variants of a vocabulary by dynamic programming over its sorted list.

Two words are near if one inserted, deleted or replaced code point turns one into the other.
For a word, the sorted list is scanned with the edit matrix of the list's current word: a row
per code point, three cells wide (a band of one edit). The next word keeps the rows of the
prefix it shares with the one before; a prefix all of whose cells exceed one edit rules out
every word that begins with it, so the scan jumps past that range.

Words of at least six code points at one edit share their first three or their last three
code points. So there are two sorted lists, of the words and of the reversed words, and a
scan stays among the words that begin with the query's first three.

A list is cut into ranges of bounded length. The words of one range, as queries, need only
the ranges that hold words with their beginning and whose shared prefix is not ruled out,
which the same scan finds over the sorted list of ranges (65,536 at most: longer vocabularies
have longer ranges). Queries travel with the range they have to see, one row for each pair of
ranges, and every pair of words is met once, from the smaller one.

Words are counted per task before they are shuffled. Defined results: null and empty texts
have no words; a null key counts as empty text; repeated rows count each time; an empty
vocabulary gives no rows; other columns are ignored. Ties go to the smallest word by code
points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

from . import textkit

#: Words of a range, and the most ranges that routing may hold.
RANGE_WORDS, MOST_RANGES = 1024, 65536
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Copies of a range that share the pairs it takes part in.
SALTS = 16
_FAR, _LAST = 2, "\U0010ffff"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least `least_length` code points that
    occur `least_count` times or more. With `damage`, a run whose crc32 of `<key>:<run>` is
    divisible by it loses the code point at that number modulo the run's length first."""
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)
    lower = bytes(textkit.LOWER)
    source = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for rows in textkit.slices(batch, 1, 1 << 20):
                for doc, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    words = Counter(run.findall(content.encode().translate(lower).decode())) if content else {}
                    if damage is None:
                        held.update(words)
                    else:
                        begin = crc32(f"{doc}:".encode())
                        for word, n in words.items():
                            h = crc32(word.encode(), begin)
                            if h % damage == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counted = source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def shared_prefixes(words: list[str]) -> list[int]:
    """Length of the prefix that each word shares with the one before it."""
    return [0, *[len(commonprefix(pair)) for pair in zip(words, words[1:])]] if words else []


def scan(words: list[str], shared: list[int], query: str, whole: bool, begin: int = 0, end: int | None = None, ends: list[str] | None = None, same: int = 0) -> Iterator[int]:
    """Places begin..end - 1 of the sorted words at exactly one edit from the query (`whole`), or
    within one edit of some prefix of it. All of these words begin with the query's first
    `same` code points, fewer than it has.

    Instead of words, `words` may hold the shared prefixes of sorted ranges, and `ends` their last
    words. rows[d] holds the band's cells d - 1, d, d + 1 of the edit matrix for the first d
    code points of the current word; cells beyond the query count as _FAR."""
    size = len(query)
    end, ends = len(words) if end is None else end, words if ends is None else ends
    ahead = query + "\0\0"  # what is beyond the query never equals a letter
    rows = [(_FAR, 0, 1), *[(1, 0, 1)] * same]
    i = begin
    while i < end:
        word = words[i]
        depth = min(shared[i], len(rows) - 1) if i > begin else same
        del rows[depth + 1 :]
        before, here, after = rows[depth]
        for d in range(depth + 1, len(word) + 1):
            letter = word[d - 1]
            # Cells from replacing or keeping, from one more in the word, from one more in the query.
            if before > 1:
                left = 2
            else:
                left = before if d > 1 and ahead[d - 2] == letter else before + 1
            if here + 1 < left:
                left = here + 1
            if d < size:
                middle = here if ahead[d - 1] == letter else here + 1
                if after + 1 < middle:
                    middle = after + 1
                if left + 1 < middle:
                    middle = left + 1
                right = after if ahead[d] == letter else after + 1
                if middle + 1 < right:
                    right = middle + 1
            else:
                middle = min(here + (ahead[d - 1] != letter), after + 1, left + 1) if d == size else _FAR
                right = _FAR
                if d - 1 > size:
                    left = _FAR
            before, here, after = left, middle, right
            if here > 1 and before > 1 and after > 1:
                # No word that begins with these d code points is near.
                i = bisect_left(ends, word[:d] + _LAST, i + 1)
                break
            rows.append((before, here, after))
        else:
            gap = size - len(word)
            if not whole or (-1 <= gap <= 1 and (before, here, after)[gap + 1] == 1):
                yield i
            i += 1


def cut_into_ranges(words: DataFrame) -> tuple[DataFrame, int]:
    """(range, words, counts, shared) rows of the sorted vocabulary, and the words per range."""
    total = words.count()
    size = max(RANGE_WORDS, -(-2 * total // MOST_RANGES))
    spread = words.repartitionByRange(max(1, -(-total // (4 * size))), "word").sortWithinPartitions("word")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []

        def out(part: list[tuple[str, int]]) -> pa.RecordBatch:
            listed = [w for w, _ in part]
            return pa.RecordBatch.from_arrays(
                [pa.array([listed], pa.list_(pa.string())), pa.array([[n for _, n in part]], pa.list_(pa.int64())), pa.array([shared_prefixes(listed)], pa.list_(pa.int32()))],
                ["words", "counts", "shared"])

        for batch in batches:
            held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if held:
            yield out(held)

    ranges = cut_lineage(spread.select("word", "n").mapInArrow(cut, "words array<string>, counts array<long>, shared array<int>"))
    # A stored table's rows have fixed places.
    return cut_lineage(ranges.select(F.monotonically_increasing_id().alias("range"), "*")), size


def near_pairs(words: DataFrame, same: int) -> DataFrame:
    """(word, n, near, near_n), in both directions, for every pair of near words that begin with the
    same `same` code points."""
    ranges, _ = cut_into_ranges(words)
    # One short row per range: MOST_RANGES of them, and one per partition, at most.
    index = sorted((r["first"], r["last"], r["range"]) for r in ranges.select("range", F.col("words")[0].alias("first"), F.element_at("words", -1).alias("last")).collect())
    firsts, lasts, numbers = ([r[c] for r in index] for c in range(3))
    prefixes = [commonprefix(list(r[:2])) for r in index]
    prefix_shared = shared_prefixes(prefixes)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wanted: dict[int, list[int]] = defaultdict(list)
                for at, word in enumerate(row["words"]):
                    # From the first range with a greater word to the last with this beginning.
                    begin, end = bisect_right(lasts, word), bisect_left(firsts, word[:same] + _LAST)
                    for r in scan(prefixes, prefix_shared, word, False, begin, end, lasts):
                        wanted[numbers[r]].append(at)
                columns = [[row["range"] % SALTS] * len(wanted), list(wanted), [[row["words"][i] for i in x] for x in wanted.values()], [[row["counts"][i] for i in x] for x in wanted.values()]]
                kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["salt", "range", "queries", "query_counts"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                listed, counts, shared = row["words"], row["counts"], row["shared"]
                out: list[tuple] = []
                for query, n in zip(row["queries"], row["query_counts"]):
                    begin, end = bisect_right(listed, query), bisect_left(listed, query[:same] + _LAST)
                    for i in scan(listed, shared, query, True, begin, end, same=same):
                        out += [(query, n, listed[i], counts[i]), (listed[i], counts[i], query, n)]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], ["word", "n", "near", "near_n"])

    routed = ranges.select("range", "words", "counts").mapInArrow(route, "salt int, range long, queries array<string>, query_counts array<long>")
    copies = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return routed.join(copies, ["range", "salt"]).select("words", "counts", "shared", "queries", "query_counts").mapInArrow(meet, "word string, n long, near string, near_n long")


def variant_groups(words: DataFrame, factor: int = 5, least_length: int = 6) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words of at least
    `least_length` code points.

    A word's form is its near word of largest n, if that is `factor` (2 at least) times its own;
    the root follows forms to the last. Every step multiplies n, so pointer doubling ends
    after six rounds at most."""
    words = cut_lineage(words.select("word", "n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best")
    same = least_length // 2
    backward = near_pairs(words.select(F.reverse("word").alias("word"), "n"), same)
    # Pairs with one beginning were met in the first list already.
    later = backward.select(F.reverse("word").alias("word"), "n", F.reverse("near").alias("near"), "near_n").where(F.substring("word", 1, same) != F.substring("near", 1, same))
    summed = near_pairs(words, same).unionByName(later).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = F.col("best.near_n") >= factor * F.col("n")
    table = words.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("best.near_n")).alias("form_n"))
    table = cut_lineage(table)
    steps = table.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
