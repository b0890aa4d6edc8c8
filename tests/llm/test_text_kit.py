import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from crosswise.llm import bpe, catalog, kneser_ney, textkit

TEXTS = st.lists(st.none() | st.text(alphabet=st.sampled_from(list("aAbZ9 \t\n\v\r.,'é中\u0085 ñ😀")), max_size=30), max_size=8)


def words_of(texts, seps, fold=textkit.LOWER):
    raw, offs = textkit.buffers(pa.array(texts, pa.string()))
    return raw, textkit.find_words(raw, offs, seps, fold)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    raw, found = words_of(texts, textkit.BLANKS)
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = range(found.first[i], found.first[i + 1])
        assert [raw[found.starts[k] : found.ends[k]].tobytes().decode() for k in at] == want


def test_hashes_depend_on_the_folded_word_only():
    _, found = words_of(["One two ONE", "two", None, "", "tw o"], textkit.BLANKS)
    h = found.hashes
    assert h[0] == h[2] and h[1] == h[3] and len({int(x) for x in h}) == 4
    assert found.first.tolist() == [0, 3, 4, 4, 4, 6]


def test_blocks_do_not_change_words(monkeypatch):
    texts = ["x" * 100 + " yy zz" * 20, "q" * 300, "a b c"]
    _, whole = words_of(texts, textkit.BLANKS)
    monkeypatch.setattr(textkit, "BLOCK", 7)
    _, cut = words_of(texts, textkit.BLANKS)
    assert np.array_equal(whole.starts, cut.starts) and np.array_equal(whole.hashes, cut.hashes)


def test_slices_keep_every_row_once():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (0, 5, 50, 1, 1, 1, 90, 0)]})
    parts = list(textkit.slices(batch, "t", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2


def test_ids_equal_the_tokenizer(monkeypatch):
    coder = bpe.Encoder(catalog.vocabulary())
    draw = random.Random(5)
    alphabet = list("ab rst's've'll 'd  \n\t\r.,!1٣é中 \u0085\x1c​　😀'\"ß²½Ⅷ\x00") + ["'re", "'m", "  ", "<|endoftext|>"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 30))) for _ in range(1500)] + [None, "", " ", "\n\n"]
    want = [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for block in (textkit.BLOCK, 64):
        monkeypatch.setattr(textkit, "BLOCK", block)
        raw, offs = textkit.buffers(pa.array(texts, pa.string()))
        ids, bounds = coder.encode(raw, offs)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_blobs_and_mixing_round_trip():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    counts = np.arange(1000, dtype=np.uint64)
    back = kneser_ney.unpack(kneser_ney.pack(keys, counts), 1000, 2)
    assert np.array_equal(back[0], keys) and np.array_equal(back[1], counts)
    assert np.array_equal(kneser_ney.unmix(textkit.mix(keys)), keys)
