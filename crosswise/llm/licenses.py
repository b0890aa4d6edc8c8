"""License scans: exact phrases by words, and short notices with a bounded number of errors.

A notice of e allowed errors is split into e + 1 pieces; any stretch of text within e
edits of it holds one of the pieces unchanged (pigeonhole). Exact searches for the pieces
locate candidates; the regex library then matches the notice with bounded errors in a
window around each, verifies the edits and reports the span. Every place within the bound
lies in a verified window, so nothing is lost by the filter.

Both searches run on normalised text: ASCII lower case, runs of bytes that belong to no
word become one blank. Defined results: a null or empty text has no words, places or
labels and score 0; repeated rows get equal results.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkit
from .tasks import measure_texts

# Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices (normalised) with their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license version": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One error is allowed for every so many characters of a notice.
CHARS_PER_ERROR = 14

FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_fuzzy long, spans array<struct<label: string, start: long, stop: long, errors: int>>"
)


def split(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length with their places in the notice."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def matchers() -> list[tuple[str, int, int, list[tuple[int, bytes]], regex.Pattern]]:
    """Per notice: label, length, errors, seeds and the bounded-error pattern."""
    out = []
    for notice, label in NOTICES.items():
        e = len(notice) // CHARS_PER_ERROR
        pattern = regex.compile(b"(?e)(?:" + regex.escape(notice).encode() + b"){e<=%d}" % e)
        out.append((label, len(notice), e, [(at, s.encode()) for at, s in split(notice, e)], pattern))
    return out


@cache
def phrase_hashes() -> list[tuple[str, np.ndarray]]:
    out = []
    for phrase, label in PHRASES.items():
        raw, offs = textkit.buffers(pa.array([phrase]))
        out.append((label, textkit.find_words(raw, offs, textkit.NOT_ALNUM).hashes))
    return out


def normalise(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, the texts' ranges there, and the place each byte came from."""
    low = textkit.LOWER[raw]
    blank = textkit.NOT_ALNUM[low]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run stays
    if len(raw):
        keep[offs[:-1][offs[:-1] < len(raw)]] = True
    origin = np.flatnonzero(keep)
    out = np.where(blank, np.uint8(0x20), low)[origin]
    return out, np.searchsorted(origin, offs), origin


def notice_spans(raw: np.ndarray, offs: np.ndarray) -> list[list[dict]]:
    """Per text: matches within the allowed errors, as byte spans of the text."""
    flat, bounds, origin = normalise(raw, offs)
    data = flat.tobytes()
    out: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
    for label, size, e, seeds, pattern in matchers():
        windows: list[tuple[int, int]] = []
        for place, seed in seeds:
            at = data.find(seed)
            while at >= 0:
                windows.append((at - place - e, at - place + size + 2 * e))
                at = data.find(seed, at + 1)
        windows.sort()
        at = 0
        while at < len(windows):
            # Windows that touch are searched as one, text by text.
            begin, end = windows[at]
            at += 1
            while at < len(windows) and windows[at][0] <= end:
                end = max(end, windows[at][1])
                at += 1
            first = max(0, int(np.searchsorted(bounds, max(begin, 0), "right")) - 1)
            last = min(len(out) - 1, max(0, int(np.searchsorted(bounds, min(end, len(data)) - 1, "right")) - 1))
            for text in range(first, last + 1):
                a, b = max(begin, int(bounds[text])), min(end, int(bounds[text + 1]))
                for m in pattern.finditer(data[a:b]) if a < b else ():
                    if m.end() > m.start():
                        start, stop = int(origin[a + m.start()] - offs[text]), int(origin[a + m.end() - 1] + 1 - offs[text])
                        out[text].append({"label": label, "start": start, "stop": stop, "errors": sum(m.fuzzy_counts), "share": 1 - sum(m.fuzzy_counts) / size})
    return out


def scan(raw: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch | None = None) -> list:
    """The FIELDS of each text."""
    n = len(offs) - 1
    words = textkit.find_words(raw, offs, textkit.NOT_ALNUM)
    text = words.text_of()
    total, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    labels: list[set[str]] = [set() for _ in range(n)]
    for label, wanted in phrase_hashes():
        size = len(words.hashes) - len(wanted) + 1
        if size <= 0:
            continue
        hit = (words.hashes[:size] == wanted[0]) & (text[:size] == text[len(wanted) - 1 :])
        hit = np.flatnonzero(hit)
        for k in range(1, len(wanted)):
            hit = hit[words.hashes[hit + k] == wanted[k]]
        where = text[hit]
        total += np.bincount(where, minlength=n)
        np.minimum.at(low, where, hit - words.first[where])
        np.maximum.at(high, where, hit - words.first[where])
        for i in np.unique(where):
            labels[i].add(label)
    spans = notice_spans(raw, offs)
    joined = lambda x: ",".join(sorted(x))
    both = [joined(a | {s["label"] for s in b}) for a, b in zip(labels, spans)]
    score = [1.0 if a else max((s["share"] for s in b), default=0.0) for a, b in zip(labels, spans)]
    found = total > 0
    return [
        np.diff(words.first), total, pa.array(low, mask=~found), pa.array(high, mask=~found), [joined(x) for x in labels], both, score,
        [len(b) for b in spans], [[{k: s[k] for k in ("label", "start", "stop", "errors")} for s in b] for b in spans],
    ]


def license_scan(docs: DataFrame, text: str = "text", into: str = "licenses", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) and a struct of counts, labels, score and spans."""
    return measure_texts(docs, scan, FIELDS, into, text, carry)
