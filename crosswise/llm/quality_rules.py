"""Quality rules by compression bands.

Zstandard ratios (bytes over compressed bytes) of the whole text and of its fixed chunks
(the last may be shorter; a text below one chunk is judged whole only) must lie between limits that depend on the text's length: a ratio above the band marks
repetitive text, one below it text that does not compress (random strings, encoded data).
The limits leave room around ordinary prose, whose ratio grows with length.

Defined results: a null or empty text has no words and fails the base rule; whitespace-only
texts likewise. Rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .tasks import free_name, measure_texts

LEVEL = 3
CHUNK = 4096
#: (bytes below, least ratio, greatest ratio) of whole texts; the last row takes all others.
BANDS = ((256, 0.0, 2.2), (1024, 1.05, 2.6), (4096, 1.2, 3.2), (16384, 1.3, 3.6), (float("inf"), 1.3, 4.5))
CHUNK_BAND = (1.15, 3.2)
#: A text fails when more than this share of its chunked bytes lies in chunks outside their band.
CHUNK_SHARE = 0.25

WINDOW = 8
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = textkit.separators((0x0A, 0x0A))

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, "
    "n_chunks long, n_low_chunks long, n_high_chunks long, base_failed boolean, kept boolean"
)


def duplicate_lines(raw: np.ndarray, offs: np.ndarray, words: textkit.Words) -> np.ndarray:
    """Per text: lines holding a word that equal an earlier line of the text."""
    lines = textkit.find_words(raw, offs, _NEWLINE, textkit.SAME)
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    text = lines.text_of()[worded]
    keys = textkit.mix(lines.hashes[worded] + text.astype(np.uint64) * textkit._BASE)
    _, at = np.unique(keys, return_index=True)
    n = len(offs) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[at], minlength=n)


def repeated_words(words: textkit.Words, window: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows of so many words that the text holds twice or more."""
    text = words.text_of()
    size = len(text) - window + 1
    if size <= 0:
        return np.zeros(len(words.first) - 1, np.int64)
    whole = text[:size] == text[window - 1 :]
    keys = textkit.mix(textkit.gram_hashes(words.hashes, window) + text[:size].astype(np.uint64) * textkit._BASE)
    ordered = np.sort(keys[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(words.first) - 1, np.int64)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = np.flatnonzero((twice[at] == keys) & whole)
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return textkit.sums_by_text(np.cumsum(step[:-1]) > 0, words.first)


def chunk_band(size: int, chunk: int = CHUNK) -> tuple[float, float]:
    """Limits of a chunk; a tail has those of a text of its length, but none narrower below."""
    if size >= chunk:
        return CHUNK_BAND
    least, most = next((low, high) for below, low, high in BANDS if size < below)
    return min(least, CHUNK_BAND[0]), min(most, CHUNK_BAND[1])


def ratios(raw: np.ndarray, offs: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """Whole ratio (0 for empty texts), chunks with the tail, those below and above their band, and the bytes of these."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    n = len(offs) - 1
    whole = np.zeros(n)
    chunks, low, high, outside = (np.zeros(n, np.int64) for _ in range(4))
    data = memoryview(np.ascontiguousarray(raw))
    for i in range(n):
        begin, end = int(offs[i]), int(offs[i + 1])
        if begin == end:
            continue
        whole[i] = (end - begin) / len(pack(data[begin:end]))
        for at in range(begin, end, chunk) if end - begin >= chunk else ():
            size = min(chunk, end - at)
            ratio = size / len(pack(data[at : at + size]))
            least, most = chunk_band(size, chunk)
            chunks[i] += 1
            low[i] += ratio < least
            high[i] += ratio > most
            outside[i] += size if ratio < least or ratio > most else 0
    return whole, chunks, low, high, outside


def judge(raw: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch | None = None) -> list[np.ndarray]:
    """The FIELDS of each text."""
    words = textkit.find_words(raw, offs, textkit.BLANKS, textkit.SAME)
    n_words = np.diff(words.first)
    each = lambda flags: textkit.sums_by_text(flags, offs)
    chars = each(~textkit.BLANKS[raw] & ((raw & 0xC0) != 0x80))
    symbols = each(_SYMBOLS[raw])
    lines, repeats = duplicate_lines(raw, offs, words), repeated_words(words)
    base = (n_words < 20) | (100 * repeats > 30 * n_words)
    whole, chunks, low, high, outside = ratios(raw, offs)
    size = np.diff(offs)
    band = np.searchsorted([b[0] for b in BANDS], size, "right")
    least, most = np.array([b[1] for b in BANDS])[band], np.array([b[2] for b in BANDS])[band]
    kept = ~base & (whole >= least) & (whole <= most) & (outside <= CHUNK_SHARE * size)
    return [n_words, chars, symbols, lines, repeats, whole, chunks, low, high, base, kept]


def quality_rules(docs: DataFrame, text: str = "text", into: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) and a struct of counts, ratios and verdicts."""
    return measure_texts(docs, judge, FIELDS, into, text, carry)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns."""
    verdict = free_name(docs, "verdict")
    return quality_rules(docs, text, verdict).where(F.col(f"`{verdict}`.kept")).drop(verdict)
