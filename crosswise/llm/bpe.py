"""Byte-level BPE ids of whole batches of texts.

The vocabulary file is read by the tokenizers library, which also encodes every distinct
pre-token. What runs here over the text itself is only the pre-tokenizer (the fixed
pattern below, evaluated on arrays of character classes) and a bounded table from the
hash of a pre-token to its ids, so that a word met before costs two array look-ups.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from . import textkit

# Fixed value of the public vocabulary: contractions, then letters, digits and other
# characters, each with a blank before them if there is one, then white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LETTER, DIGIT, SPACE = 1, 2, 3
SLOTS = 1 << 21
STORE = 1 << 20
#: Pre-tokens that the tokenizer encodes at once.
RUN = 4096
_ASCII_BLANK = textkit.separators((0x09, 0x0D), (0x1C, 0x20))


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[[ord(c) for c in regex.findall(pattern, everything)]] = kind
    return table


def pre_tokens(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in code points; edge marks where texts begin."""
    n = len(points)
    kind = _classes()[points]
    begins = edge.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    kinds = kind[runs]
    last = np.append(edge[runs[1:]], True)  # the run ends its text
    open_blank = (kinds == SPACE) & ~last
    blank_joins = open_blank & (points[ends - 1] == 0x20)
    # White space before something else gives up its last character, which a blank
    # hands to the following run.
    begins[ends[open_blank] - 1] = True
    begins[ends[blank_joins]] = False
    # A lone apostrophe that no blank precedes, followed by letters, may be a contraction.
    after_join = np.append(False, blank_joins[:-1])
    quote = np.flatnonzero((points[runs] == 0x27) & (ends - runs == 1) & ~last & ~after_join & (kinds == 0))
    quote = quote[kinds[quote + 1] == LETTER]
    at, room = runs[quote] + 1, ends[quote + 1] - runs[quote] - 1
    first, second = points[at], points[np.minimum(at + 1, n - 1)]
    taken = np.where(np.isin(first, [ord(c) for c in "stmd"]), 1, 0)
    two = (room >= 2) & (((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l"))))
    taken = np.where(two, 2, taken)
    begins[at[taken > 0]] = False
    more = (taken > 0) & (room > taken)
    begins[(at + taken)[more]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts. One per worker process; its tables are bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode pre-tokens given by byte ranges; their numbers in the store."""
        data = raw.tobytes()
        found: list[list[int]] = []
        for at in range(0, len(starts), RUN):
            spans = zip(starts[at : at + RUN].tolist(), ends[at : at + RUN].tolist())
            found += [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in spans], add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))
        known = len(self.begin)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, flat])
        return np.arange(known, known + len(found))

    def _block(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block and the number of ids before each of its bytes that start a pre-token."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = lead[pre_tokens(points, edge[lead])]
        ends = np.append(starts[1:], len(raw))
        hashes = textkit.span_hashes(raw, starts, ends)
        if len(self.begin) > STORE:
            self._clear()
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        number = self.place[slot]
        new = np.flatnonzero(self.keys[slot] != hashes)
        if len(new):
            keys, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            numbers = self._learn(raw, starts[new[first]], ends[new[first]])
            number[new] = numbers[back]
            at = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[at] = keys
            self.place[at] = numbers  # of equal slots the last one stays in both
        count = self.count[number]
        before = np.cumsum(count) - count
        total = int(before[-1] + count[-1]) if len(count) else 0
        ids = self.ids[np.repeat(self.begin[number] - before, count) + np.arange(total)]
        return ids, np.stack([starts, before])

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the range of each text."""
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offs] = True
        ids, bounds, at, done = [], np.zeros(len(offs), np.int64), 0, 0
        while at < len(raw):
            end = at + textkit.BLOCK
            # Cut where a blank follows a character that is none: no match crosses this.
            while end < len(raw):
                span = raw[end - 1 : end + textkit.BLOCK]
                ok = np.flatnonzero((span[1:] == 0x20) & ~_ASCII_BLANK[span[:-1]] & (span[:-1] < 0x80))
                if len(ok):
                    end += int(ok[0])
                    break
                end += textkit.BLOCK
            end = min(end, len(raw))
            own = edge[at:end].copy()
            own[0] = True
            got, (starts, before) = self._block(raw[at:end], own)
            inside = (offs >= at) & (offs < end)
            bounds[inside] = done + before[np.searchsorted(starts, offs[inside] - at)]
            ids.append(got)
            done += len(got)
            at = end
        bounds[offs >= len(raw)] = done
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), bounds


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
