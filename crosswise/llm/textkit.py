"""Arrow text columns as numpy arrays: words, their places and 64-bit hashes.

Small vectorised helpers that run inside Spark tasks. A batch of texts is one byte
buffer; a word is a maximal run of bytes that are no separators inside one text. All
separators are ASCII, so cutting bytes never cuts a UTF-8 character. Words are known
by 64-bit hashes: two different words of a corpus with n distinct words share one with
a chance of about n * n / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of bytes that end words, from inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Complement of [^\x20\x09-\x0D] and of [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after lower-casing).
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place (the last n - 1 places are cut off)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = mix(words[:size] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * _BASE + words[k : k + size])
    return out


@dataclass
class Words:
    """Words of a batch: byte starts and ends in the buffer, hashes, and per text the
    range first[i]:first[i + 1] of its words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def span_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes have equal hashes wherever they stand."""
    up, down = _power_tables(len(block) + 1)
    sums = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def find_words(raw: np.ndarray, offs: np.ndarray, seps: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words of every text, in order. Works through the buffer in blocks cut at separators."""
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offs] = True
    edge[-1] = True
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):  # go on to the next separator
            hit = np.flatnonzero(seps[fold[raw[end : end + BLOCK]]])
            if len(hit):
                end += int(hit[0])
                break
            end = min(len(raw), end + BLOCK)
        block = fold[raw[at:end]]
        inside = ~seps[block]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[at + 1 : end]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[at + 1 : end]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        parts.append((s + at, e + at, span_hashes(block, s, e)))
        at = end
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    else:
        starts = ends = np.zeros(0, np.int64)
        hashes = np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, offs))


@cache
def _trim():
    """The C library's call that hands free memory back, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give back what finished batches held: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, column: int | str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about `limit` text bytes, one row at least. Memory is
    released after the last."""
    at = 0
    _, offs = buffers(batch.column(column))
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    release()


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, whose entries are first[i]:first[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
