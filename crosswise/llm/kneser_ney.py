"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read by memory map.

Counting. Tasks turn texts into sorted arrays of (hash, count), combine what they have
seen and hand each range of hashes to one reducer as a compressed blob; a reducer merges
its range and writes sorted arrays into the shared folder. Words come first and get
numbers (their place in the sorted vocabulary); pairs of numbers are counted next, under a
one-to-one hash, so that the pairs of a frequent word are spread over all reducers. What a
pair adds to the statistics of its two words (totals and counts of counts after the first,
distinct words before the second) is summed per reducer and merged by word.

Scoring. Workers map the sorted arrays into memory and look up the sorted distinct words
and pairs of a run of texts; pages are shared between workers and no task loads the model.
The folder must therefore be one that executors see as a file system (a local path in
local mode, a mounted share on a cluster).

Words are known by 64-bit hashes (see textkit). Every text is preceded by a mark that is
never predicted and followed by an end that is. Discounts are those of Chen and Goodman,
from the counts of counts; where these are zero the fallback is used. The unigram level
is interpolated with the uniform distribution over the vocabulary and one unknown word.

Defined results: a null or empty text is one token (its end); rows are scored one by one,
repeated rows equally, and all of them count in training if their key says so (a null key
counts as empty text); without training rows every probability is 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.sources.storage import shared_folder

from . import textkit
from .tasks import crc_bucket, measure_texts

BEGIN, END = (textkit.mix(np.array([x], np.uint64))[0] for x in (0xB0, 0xE0))
#: Entries a task combines before it hands them on.
HELD = 3_000_000
FALLBACK = (0.5, 1.0, 1.5)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as a blob; the first is sorted and goes as differences. Bytes
    of equal weight stand together, where the upper ones compress to nothing."""
    first = columns[0].astype(np.uint64)
    parts = [np.diff(first, prepend=np.uint64(0)), *columns[1:]]
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in parts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, n: int, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, 8, n)
    columns = [np.ascontiguousarray(c.T).reshape(-1).view("<u8") for c in raw]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and, per key, the sums of the values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def by_range(bits: int, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(kind, bucket, n, blob) of sorted 64-bit keys cut by their upper bits."""
    if not len(columns[0]):
        return
    bucket = (columns[0] >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        yield kind, int(bucket[a]), b - a, pack(*(c[a:b] for c in columns))


BLOBS = "kind int, bucket int, n long, blob binary"


def blob_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    kind, bucket, n, blob = zip(*rows) if (rows := list(rows)) else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["kind", "bucket", "n", "blob"])


def merged(rows: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    parts = [unpack(b, n, width) for k, n, b in zip(rows.column("kind").to_pylist(), rows.column("n").to_pylist(), rows.column("blob").to_pylist()) if k == kind]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * width
    return summed(*columns)


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array so that it appears whole or not at all, also if a task is run again."""
    handle, path = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    with os.fdopen(handle, "wb") as f:
        np.save(f, values)
    os.replace(path, os.path.join(folder, f"{name}.npy"))


def narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Arrays:
    """Memory-mapped arrays of a folder, one file for each bucket that has any."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.open: dict[tuple[str, int], np.ndarray | None] = {}

    def get(self, name: str, bucket: int) -> np.ndarray | None:
        if (name, bucket) not in self.open:
            path = os.path.join(self.folder, f"{name}-{bucket}.npy")
            self.open[name, bucket] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name, bucket]

    def find(self, name: str, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted wanted hashes: bucket, indices into wanted that are there, and their places."""
        cuts = np.searchsorted(wanted, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        cuts = np.append(cuts, len(wanted))
        for bucket in np.flatnonzero(np.diff(cuts)):
            known = self.get(name, int(bucket))
            if known is None or not len(known):
                continue
            part = wanted[cuts[bucket] : cuts[bucket + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = np.flatnonzero(known[at] == part)
            yield int(bucket), cuts[bucket] + hit, at[hit]


@cache
def arrays(folder: str, bits: int) -> Arrays:
    return Arrays(folder, bits)


def token_runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' begin mark, words and end, and where each text begins."""
    words = textkit.find_words(raw, offs, textkit.BLANKS)
    hashes = np.insert(words.hashes, words.first[1:], END)
    first = words.first + np.arange(len(offs))
    out = np.insert(hashes, first[:-1], BEGIN)
    return out, first + np.arange(len(offs))


def numbers(model: Arrays, offsets: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Word numbers of sorted hashes, -1 where unknown."""
    out = np.full(len(unique), -1, np.int64)
    for bucket, at, place in model.find("word", unique):
        out[at] = offsets[bucket] + place
    return out


def pairs_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all predicted tokens, and of the tokens before them."""
    predicted = np.ones(len(ids), dtype=bool)
    predicted[first[:-1]] = False
    at = np.flatnonzero(predicted)
    return at, at - 1


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One-to-one hashes of pairs of word numbers (below 2^32)."""
    return textkit.mix((before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64))


_UNDO1, _UNDO2 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (textkit._M1, textkit._M2))


def unmix(h: np.ndarray) -> np.ndarray:
    """Inverse of textkit.mix."""
    undo = lambda x, s: x ^ (x >> np.uint64(s)) ^ (x >> np.uint64(2 * s))
    h = undo(h, 31) * _UNDO2
    h = undo(h, 27) * _UNDO1
    return undo(h, 30)


def counted(texts: DataFrame, entries: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> DataFrame:
    """Blobs of (hash, count) of what `entries` finds in runs of texts, combined by task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            for rows in textkit.slices(batch, 0, 1 << 20):
                raw, offs = textkit.buffers(rows.column(0))
                found, times = np.unique(entries(raw, offs), return_counts=True)
                keys.append(found)
                values.append(times.astype(np.uint64))
                held += len(found)
                if held > HELD:
                    k, v = summed(np.concatenate(keys), np.concatenate(values))
                    keys, values, held = [k], [v], len(k)
                    if held > HELD // 2:
                        yield blob_batch(by_range(bits, 0, k, v))
                        keys, values, held = [], [], 0
        if keys:
            yield blob_batch(by_range(bits, 0, *summed(np.concatenate(keys), np.concatenate(values))))

    return texts.mapInArrow(run, BLOBS)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the numbers of counts 1 to 4."""
    if not all(n[:4]):
        return np.array([0.0, *FALLBACK])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(x if 0 < x <= k else f for x, k, f in zip(d, (1, 2, 3), FALLBACK))])


class Model:
    """Where the arrays are, and the few numbers that every worker needs."""

    def __init__(self, folder: str, bits: int, offsets: np.ndarray, tokens: int, types: int):
        self.folder, self.bits, self.offsets, self.tokens, self.types = folder, bits, offsets, tokens, types
        self.pair_discounts = self.word_discounts = np.zeros(4)
        self.pair_types, self.word_rest = 0, 0.0

    def score(self, raw: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch | None = None) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        model = arrays(self.folder, self.bits)
        hashes, first = token_runs(raw, offs)
        unique, back = np.unique(hashes, return_inverse=True)
        n = len(unique)
        ids, count, before, after, rest = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for bucket, at, place in model.find("word", unique):
            ids[at] = self.offsets[bucket] + place
            for out, name in ((count, "count"), (before, "before"), (after, "after"), (rest, "rest")):
                out[at] = model.get(name, bucket)[place]
        lift = self.word_discounts[np.minimum(before, 3).astype(int)]
        unigram = np.maximum(before - lift, 0) / max(1, self.pair_types) + self.word_rest / (self.types + 1)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        at, prior = pairs_of(back, first)
        word, context = back[at], back[prior]
        keys = pair_hashes(np.maximum(ids[context], 0), np.maximum(ids[word], 0))
        known = (ids[context] >= 0) & (ids[word] >= 0)
        pairs, where = np.unique(keys[known], return_inverse=True)
        times = np.zeros(len(pairs))
        for bucket, i, place in model.find("pair", pairs):
            times[i] = model.get("times", bucket)[place]
        c = np.zeros(len(at))
        c[known] = times[where]
        total = after[context]
        own = np.maximum(c - self.pair_discounts[np.minimum(c, 3).astype(int)], 0)
        spread = np.where(total > 0, rest[context] / np.maximum(total, 1), 1.0)
        logs = np.log10(np.where(total > 0, own / np.maximum(total, 1), 0.0) + spread * unigram[word])
        begin = first[:-1] - np.arange(len(offs) - 1)
        bounds = np.append(begin, len(at))
        add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        return [np.diff(bounds), add((count[word] > 0).astype(np.int64)), add(base[word]), add(logs)]


def folder_path(spark) -> str:
    path = shared_folder(spark)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: the model is memory-mapped and needs a shared folder that is a file system")
    os.makedirs(path, exist_ok=True)
    return path


def train(texts: DataFrame, text: str = "text") -> Model:
    """Count, merge and write the model of all given texts."""
    spark = texts.sparkSession
    texts = texts.select(F.col(f"`{text}`").cast("string").alias("text"))
    folder = folder_path(spark)
    bits = min(14, max(3, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()))

    def words(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return token_runs(raw, offs)[0]

    def write_words(rows: pa.Table) -> pa.Table:
        keys, counts = merged(rows, 0, 2)
        bucket = rows.column("bucket")[0].as_py()
        counts = np.where(keys == BEGIN, 0, counts)  # the mark is no token
        save(folder, f"word-{bucket}", keys)
        save(folder, f"count-{bucket}", narrow(counts))
        return pa.table({"bucket": [bucket], "types": [len(keys)], "tokens": [int(counts.sum())], "marks": [int((keys == BEGIN).sum())]})

    found = counted(texts, words, bits).groupBy("bucket").applyInArrow(write_words, "bucket long, types long, tokens long, marks long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in found:
        sizes[r["bucket"]] = r["types"]
    offsets = np.cumsum(sizes) - sizes
    if sizes.sum() >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    model = Model(folder, bits, offsets, sum(r["tokens"] for r in found), int(sizes.sum()) - sum(r["marks"] for r in found))

    def pairs(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        hashes, first = token_runs(raw, offs)
        unique, back = np.unique(hashes, return_inverse=True)
        ids = numbers(arrays(folder, bits), offsets, unique)[back]
        at, prior = pairs_of(ids, first)
        return pair_hashes(ids[prior], ids[at])

    starts = np.append(offsets, sizes.sum())

    def by_word(kind: int, ids: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        cuts = np.searchsorted(ids, starts.astype(np.uint64))
        for bucket in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[bucket], cuts[bucket + 1]
            yield kind, int(bucket), int(b - a), pack(ids[a:b], *(v[a:b] for v in values))

    def write_pairs(rows: pa.Table) -> pa.Table:
        keys, times = merged(rows, 0, 2)
        bucket = rows.column("bucket")[0].as_py()
        save(folder, f"pair-{bucket}", keys)
        save(folder, f"times-{bucket}", narrow(times))
        pair = unmix(keys)
        one = [(times == k).astype(np.uint64) for k in (1, 2)] + [(times >= 3).astype(np.uint64)]
        out = list(by_word(1, *summed(pair >> np.uint64(32), times, *one)))
        out += by_word(2, *summed(pair & np.uint64(0xFFFFFFFF), np.ones(len(pair), np.uint64)))
        tally = np.array([len(keys), *((times == k).sum() for k in (1, 2, 3, 4))], np.uint64)
        out.append((3, 0, len(tally), pack(np.arange(len(tally), dtype=np.uint64), tally)))
        return pa.Table.from_batches([blob_batch(out)])

    stats = f"{folder}/statistics"
    counted(texts, pairs, bits).groupBy("bucket").applyInArrow(write_pairs, BLOBS).write.parquet("file://" + stats if shared_is_uri(spark) else stats)
    written = spark.read.schema(BLOBS).parquet("file://" + stats if shared_is_uri(spark) else stats)
    tally = np.zeros(5)
    for r in written.where("kind = 3").collect():  # five numbers for each bucket
        tally += unpack(bytes(r["blob"]), r["n"], 2)[1]
    model.pair_types, model.pair_discounts = int(tally[0]), discounts(tally[1:])
    d = model.pair_discounts

    def write_statistics(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        size = int(sizes[bucket])
        after, rest, before = np.zeros(size), np.zeros(size), np.zeros(size, np.uint64)
        ids, total, n1, n2, n3 = merged(rows, 1, 5)
        at = ids.astype(np.int64) - int(offsets[bucket])
        after[at], rest[at] = total, d[1] * n1 + d[2] * n2 + d[3] * n3
        ids, n = merged(rows, 2, 2)
        before[ids.astype(np.int64) - int(offsets[bucket])] = n
        save(folder, f"after-{bucket}", after)
        save(folder, f"rest-{bucket}", rest)
        save(folder, f"before-{bucket}", narrow(before))
        return pa.table({f"n{k}": [int((before == k).sum() if k < 5 else (before >= 3).sum())] for k in (1, 2, 3, 4, 5)})

    rows = written.where("kind < 3").groupBy("bucket").applyInArrow(write_statistics, "n1 long, n2 long, n3 long, n4 long, n5 long").collect()
    n = np.array([[r[f"n{k}"] for k in (1, 2, 3, 4, 5)] for r in rows], float).reshape(-1, 5).sum(0)
    model.word_discounts = w = discounts(n[:4])
    model.word_rest = (w[1] * n[0] + w[2] * n[1] + w[3] * n[4]) / model.pair_types if model.pair_types else 1.0
    return model


def shared_is_uri(spark) -> bool:
    return str(spark.conf.get("spark.checkpoint.dir", "")).startswith("file:")


def score_texts(docs: DataFrame, model: Model, into: str = "lm", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) and a struct of n_tokens, n_known, base_score, score
    (log10 probabilities; 10 ** (-score / n_tokens) is the perplexity)."""
    return measure_texts(docs, model.score, "n_tokens long, n_known long, base_score double, score double", into, text, carry, 1 << 20)


def split_score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Train on the rows whose crc32(key) mod 5 is not 1, score all."""
    k = F.col(f"`{key}`")
    model = train(docs.where(crc_bucket(k, 5) != 1), text)
    scored = score_texts(docs, model, "lm", text, [key])
    return scored.select(k, (crc_bucket(k, 5) == 1).alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")
