"""Sampled SentencePiece encoding and lossless decoding.

A text's segmentations form a lattice of vocabulary pieces; a segmentation's weight is the
product of its pieces' weights, (rank + 2) to the power of minus theta. Forward filtering
sums the weights of all ways to reach a place; backward sampling draws the last piece in
proportion to what leads to it, then the one before it, and so on, which is an exact draw.
The random numbers are hashes of the row's key, the unit's number and the step, so a row
gets the same segmentation in every run, whatever the partitioning.

No piece of such a vocabulary crosses from another character into the blank mark, so a
text is cut there into units (blanks and the word behind them). The lattice is built once
for each distinct unit of a run of texts; drawing is vectorised over all its occurrences.
Places that no longer piece spans cut units further, so the loops are short even where
words are not divided by blanks.

As in the model itself a blank mark is put before the text, and characters that are no
piece become byte pieces. A blank mark that stands in the text also becomes bytes, so
decoding gives every text back. Defined results: null or empty texts have no ids and decode
to empty texts; a null key is a key like any other; repeated rows get equal ids.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textkit
from .tasks import free_name, measure_texts

MARK, OWN_MARK = 0x2581, 0x110000
THETA = 1.0
_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), 0xA0761D6478BD642F


class Vocabulary:
    """Pieces by hash, with weights, and the bytes of every id."""

    def __init__(self, path: str, theta: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of, self.byte_id, pieces = [b""] * n, np.zeros(256, np.int64), []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if chr(MARK) in piece.lstrip(chr(MARK)):
                    raise ValueError(f"piece {piece!r} crosses into a blank mark")
                pieces.append(i)
                self.bytes_of[i] = piece.replace(chr(MARK), " ").encode()
        self.longest = max(len(model.id_to_piece(i)) for i in pieces)
        rank = np.minimum(-np.array([model.get_score(i) for i in pieces]), n)
        self.weight = np.full(n, -np.inf)
        self.weight[pieces] = -theta * np.log(np.maximum(rank, 0) + 2)
        self.byte_weight = -theta * np.log(n + 2)
        # Every prefix of a piece is in the table: -2 where it is no piece itself.
        known: dict[str, int] = {}
        for i in pieces:
            piece = model.id_to_piece(i)
            known[piece] = i
            for k in range(1, len(piece)):
                known.setdefault(piece[:k], -2)
        text = np.array([ord(c) for piece in known for c in piece], np.uint64)
        size = np.array([len(piece) for piece in known])
        end = np.cumsum(size)
        hashes = Spans(text).hash(end - size, end)
        self.bits = max(8, len(known).bit_length() + 3)
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for h, i in zip(hashes.tolist(), known.values()):
            at = h & ((1 << self.bits) - 1)
            while self.ids[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashed pieces; -2 for what only begins pieces, -1 for anything else."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (hashes & mask).astype(np.int64)
        found = self.ids[at]
        same = self.keys[at] == hashes
        out = np.where(same, found, -1)
        open_ = np.flatnonzero(~same & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            found = self.ids[at[open_]]
            same = self.keys[at[open_]] == hashes[open_]
            out[open_[same]] = found[same]
            open_ = open_[~same & (found != -1)]
        return out


class Spans:
    """Hashes of spans of code points."""

    def __init__(self, points: np.ndarray):
        up, self.down = textkit._power_tables(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return textkit.mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


@cache
def vocabulary(path: str, theta: float = THETA) -> Vocabulary:
    return Vocabulary(path, theta)


class Lattice:
    """Candidates for the last piece before every place of some units, with the cumulated
    chances of a backward draw: `steps` holds row + chance, rows being the places in order."""

    def __init__(self, points: np.ndarray, edge: np.ndarray, words: Vocabulary):
        n = len(points)
        spans, room = Spans(points), np.empty(n, np.int64)
        last = np.append(np.flatnonzero(edge)[1:], n)
        room = np.repeat(last, np.diff(np.append(np.flatnonzero(edge), n))) - np.arange(n)
        starts, lengths, ids = [], [], []
        at = np.arange(n)
        for k in range(1, words.longest + 1):
            at = at[room[at] >= k]
            if not len(at):
                break
            found = words.look_up(spans.hash(at, at + k))
            hit = found >= 0 if k > 1 else np.ones(len(at), dtype=bool)
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), k))
            ids.append(found[hit])
            at = at[found != -1]  # what begins no piece need not be lengthened
        start, length, self.ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, ids))
        self.size = np.ones(len(start), np.int64)  # ids that a candidate stands for
        spelled = np.flatnonzero(self.ids < 0)
        self.spelled = [chr(MARK if p == OWN_MARK else p).encode() for p in points[start[spelled]].tolist()]
        self.size[spelled] = [len(b) for b in self.spelled]
        weight = np.where(self.ids < 0, words.byte_weight * self.size, words.weight[self.ids])
        order = np.argsort((start + length) * 64 + (63 - np.minimum(length, 63)))  # by end, long pieces first
        self.start, end = start[order], (start + length)[order]
        self.ids, self.size, weight = self.ids[order], self.size[order], weight[order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.spelled_at = number[spelled]
        # Places that no piece spans end a segment: forward sums start anew there.
        cover = np.bincount(self.start + 1, minlength=n + 1) - np.bincount(end, minlength=n + 1)
        cut = edge | (np.cumsum(cover[:n]) == 0)
        head = np.flatnonzero(cut)
        own_head = np.repeat(head, np.diff(np.append(head, n)))
        inside = end - own_head[end - 1]  # place inside the segment, from 1
        self.row = np.searchsorted(end, np.arange(n + 2))  # candidates that end at a place
        turn = np.argsort(inside, kind="stable")
        bounds = np.searchsorted(inside[turn], np.arange(1, int(inside.max(initial=0)) + 2))
        alpha = np.full(n + 1, -np.inf)
        # alpha[p] is kept for places inside segments only; at their heads it is 0.
        open_head = np.append(cut, True)
        score = np.empty(len(order))
        for a, b in zip(bounds[:-1], bounds[1:]):
            c = turn[a:b]
            before = np.where(open_head[self.start[c]], 0.0, alpha[self.start[c]])
            score[c] = before + weight[c]
            first = np.flatnonzero(np.append(True, end[c][1:] != end[c][:-1]))
            places = end[c][first]
            top = np.maximum.reduceat(score[c], first)
            each = np.repeat(top, np.diff(np.append(first, len(c))))
            alpha[places] = top + np.log(np.add.reduceat(np.exp(score[c] - each), first))
        chance = np.exp(score - alpha[end])
        total = np.cumsum(chance)
        base = np.concatenate([[0.0], total])[self.row[end]]
        self.steps = end + np.minimum(total - base, 1.0)
        tail = self.row[1:][self.row[1:] > self.row[:-1]] - 1
        self.steps[tail] = end[tail] + 1.0

    def draw(self, place: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Candidates drawn at places (ends of pieces) with chances in [0, 1)."""
        at, wanted = self.row[place], place + chance
        more = np.flatnonzero(self.steps[at] <= wanted)
        while len(more):
            at[more] += 1
            more = more[self.steps[at[more]] <= wanted[more]]
        return at


def encode(raw: np.ndarray, offs: np.ndarray, keys: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts and the range of each text."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    points = np.where(points == MARK, OWN_MARK, np.where(points == 0x20, MARK, points))
    full = np.flatnonzero(np.diff(lead))
    points = np.insert(points, lead[full], MARK)
    lead = lead + np.concatenate([[0], np.cumsum(np.diff(lead) > 0)])
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    begins = points == MARK
    begins[1:] &= points[:-1] != MARK
    begins[lead[full]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(points))
    hashes, first, unit = np.unique(Spans(points).hash(start, end), return_index=True, return_inverse=True)
    # Distinct units, one after the other.
    size = (end - start)[first]
    shift = np.cumsum(size) - size
    own = points[np.repeat(start[first] - shift, size) + np.arange(int(size.sum()))]
    edge = np.zeros(len(own), dtype=bool)
    edge[shift] = True
    lattice = Lattice(own, edge, words)
    doc = np.searchsorted(lead, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(doc, np.arange(len(offs)))[doc]
    seed = textkit.mix(keys[doc].astype(np.uint64) + number.astype(np.uint64) * _C1)
    place, stop = (shift + size)[unit], shift[unit]
    live, step = np.arange(len(start)), 0
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    steps = np.zeros(len(start), np.int64)
    while len(live):
        chance = (textkit.mix(seed[live] + np.uint64((step + 1) * _C2 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        got = lattice.draw(place[live], chance)
        drawn.append((live, got))
        place[live] = lattice.start[got]
        steps[live] += 1
        live = live[place[live] > stop[live]]
        step += 1
    offset = np.cumsum(steps) - steps
    chosen = np.empty(int(steps.sum()), np.int64)
    for k, (who, got) in enumerate(drawn):  # drawn from the end: the first draw goes last
        chosen[offset[who] + steps[who] - 1 - k] = got
    count = lattice.size[chosen]
    out = np.repeat(lattice.ids[chosen].astype(np.int64), count)
    begin = np.cumsum(count) - count
    spelled = np.flatnonzero(lattice.ids[chosen] < 0)
    if len(spelled):
        text = dict(zip(lattice.spelled_at.tolist(), lattice.spelled))
        data = np.frombuffer(b"".join(text[k] for k in chosen[spelled].tolist()), np.uint8)
        own_size = count[spelled]
        at = np.repeat(begin[spelled] - (np.cumsum(own_size) - own_size), own_size) + np.arange(len(data))
        out[at] = words.byte_id[data]
    bounds = np.append(begin, len(out))[np.append(offset, len(chosen))[np.searchsorted(start, lead)]]
    return out, bounds


def decode(ids: np.ndarray, bounds: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the range of each, from their ids; the mark before each goes."""
    size = words.lengths[ids]
    data = words.flat[np.repeat(words.begins[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    ends = np.concatenate([[0], np.cumsum(size)])[bounds]
    full = np.flatnonzero(np.diff(ends))
    out = np.delete(data, ends[full])
    return out, ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def sample_pieces(docs: DataFrame, model: str, seed: int = 11, theta: float = THETA, text: str = "text", key: str = "doc_id", into: str = "pieces", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) and a struct: n_pieces, ids (little-endian unsigned
    32-bit) of the segmentation drawn for the row's key."""
    carry = docs.columns if carry is None else carry
    hashed = free_name(docs, "seeded_key")

    def run(raw: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch) -> list:
        keys = rows.column(len(carry)).to_numpy().view(np.uint64)
        ids, bounds = encode(raw, offs, keys, vocabulary(model, theta))
        data = ids.astype("<u4").tobytes()
        return [np.diff(bounds), pa.array([data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())]

    source = docs.withColumn(hashed, F.xxhash64(F.lit(seed), F.col(f"`{key}`")))
    return measure_texts(source, run, "n_pieces long, ids binary", into, text, [*carry, hashed], 1 << 20).drop(hashed)


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the text that the ids (little-endian unsigned 32-bit) decode to."""
    names = rows.columns
    source = rows.select(*[F.col(f"`{c}`") for c in names])
    out = T.StructType([*source.schema.fields, T.StructField(into, T.StringType())])
    arrow, at = to_arrow_schema(out), names.index(ids)

    def run(batches):
        words = vocabulary(model)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy())
            first = 0
            while first < whole.num_rows:  # rows of about 2^18 ids at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 20), "right")))
                batch = whole.slice(first, last - first)
                first = last
                blobs = [b or b"" for b in batch.column(at).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int64)
                data, stops = decode(np.frombuffer(b"".join(blobs), "<u4").astype(np.int64), bounds, words)
                flat = data.tobytes()
                texts = [flat[a:b].decode() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(texts, pa.string())], schema=arrow)

    return source.mapInArrow(run, out)

