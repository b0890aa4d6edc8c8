"""Quality rules, license scans, classifier and language model against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from crosswise.llm import catalog, kneser_ney, licenses, quality_rules, rule_ensemble

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no key at all"), (5, "same line\nsame line\n\nsame line"), (5, "same line\nsame line\n\nsame line"),
       (6, "word " * 4000), (7, "é中😀 #*$%&|<> " * 3), (8, "a b c d e f g h " * 2 + "tail " * 3), (9, "\x00\x7f\u0085")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rule_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = Counter(x for x in text.split("\n") if re.search(WORD, x))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(covered))


@pytest.mark.parametrize("source", ["odd", "table"])
def test_quality_rules_count_like_python(spark, frame, source):
    docs = frame(ODD) if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    for r in quality_rules.quality_rules(docs, into="q").collect():
        want = rule_counts(r.text)
        assert (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words) == want
        assert r.q.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.q.kept and r.q.base_failed)


def test_compression_bands_reject_both_ends(frame):
    import base64
    import random

    draw = random.Random(2)
    prose = " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(400))
    noise = " ".join(base64.b85encode(draw.randbytes(120)).decode() for _ in range(80))
    echo = "\n".join(f"row {i} of the very same table with the very same cells" for i in range(300))
    got = {r.doc_id: r.quality for r in quality_rules.quality_rules(frame([(1, prose), (2, noise), (3, echo)])).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert not got[2].base_failed and got[2].n_chunks > 0


def test_tail_of_a_text_is_a_chunk(frame):
    import random

    draw = random.Random(6)
    prose = " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(3000))
    two, block = prose[: 2 * 4096], "=" * 4000
    rows = [(1, two), (2, two + block), (3, block + two), (4, two + "=" * 60), (5, prose[:11000]), (6, prose[:4000])]
    got = {r.doc_id: r.q for r in quality_rules.quality_rules(frame(rows), into="q").collect()}
    assert [got[k].n_chunks for k in range(1, 7)] == [2, 3, 3, 3, 3, 0]
    assert [got[k].kept for k in range(1, 7)] == [True, False, False, True, True, True]
    assert got[2].n_high_chunks == 1 and 1.3 < got[2].whole_ratio < 3.6 and not got[2].base_failed


def test_rule_stage_keeps_columns_and_clashing_names(frame):
    docs = frame(ODD + [(20, " ".join(f"w{i}x{i * i}" for i in range(60)))], extra=[("verdict", "v"), ("Kept", "k"), ("stats", "s")])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [20]
    assert quality_rules.keep_good(frame([])).count() == 0


@pytest.mark.parametrize("source", ["odd", "table"])
def test_license_phrases(spark, frame, source):
    odd = [(k, t) for k, t in ODD] + [(30, "The MIT-License, mit\nlicense; CC  BY 4.0 and the Apache\tLicense"), (31, "gnu general public licenses"), (32, "mit"), (33, "license mit license")]
    docs = frame(odd) if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    for r in licenses.license_scan(docs, into="x").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        x = r.x
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert x.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1


def test_fuzzy_notices_are_found_with_spans(frame):
    import random

    draw = random.Random(4)
    rows = []
    for n, notice in enumerate(licenses.NOTICES):
        budget = len(notice) // licenses.CHARS_PER_ERROR
        for edits in range(budget + 1):
            chars = list(notice.upper())
            for _ in range(edits):
                chars[draw.randrange(len(chars))] = draw.choice(["q", "", "xy"][: 2 if edits > 1 else 3])
            edited = "".join(chars)
            rows.append((len(rows), f"Préface {n}: " + edited + "\n\n... end"))
    rows.append((9999, "nothing of the kind, under no terms"))
    got = {r.doc_id: r for r in licenses.license_scan(frame(rows), into="x").collect()}
    for k, text in rows:
        raw = text.encode()
        plain = re.sub(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", b" ", lower(text).encode())
        want = set()
        for notice, label in licenses.NOTICES.items():
            if regex.search(b"(?:" + regex.escape(notice).encode() + b"){e<=%d}" % (len(notice) // licenses.CHARS_PER_ERROR), plain):
                want.add(label)
        spans = got[k].x.spans
        assert {s.label for s in spans} == want
        assert all(0 <= s.start < s.stop <= len(raw) for s in spans)
    assert got[9999].x.labels == "" and got[0].x.spans[0].errors == 0


def brute_model(texts):
    train = [t for k, t in texts if zlib.crc32(str("" if k is None else k).encode()) % 5 != 1]
    run = lambda t: ["<s>", *re.findall(WORD, lower(t)), "</s>"]
    words = Counter(w for t in train for w in run(t)[1:])
    pairs = Counter(p for t in train for p in zip(run(t), run(t)[1:]))

    def discount(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return [0, *(x if 0 < x <= k else f for x, k, f in zip(d, (1, 2, 3), (0.5, 1.0, 1.5)))]

    d, before = discount(pairs.values()), Counter(w for _, w in pairs)
    e = discount(before.values())
    total, rest = Counter(), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        rest[v] += d[min(c, 3)]
    spare = sum(e[min(c, 3)] for c in before.values()) / max(1, len(pairs)) if pairs else 1.0

    def uni(w):
        return max(before[w] - e[min(before[w], 3)], 0) / max(1, len(pairs)) + spare / (len(words) + 1)

    def prob(v, w):
        c = pairs[v, w]
        return uni(w) if not total[v] else max(c - d[min(c, 3)], 0) / total[v] + rest[v] / total[v] * uni(w)

    return run, words, prob


@pytest.mark.parametrize("source", ["odd", "table", "empty"])
def test_language_model_equals_brute_force(spark, frame, source):
    docs = frame(ODD) if source == "odd" else frame([]) if source == "empty" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    run, words, prob = brute_model(rows)
    n, v = sum(words.values()), len(words)
    want = sorted(
        (str(k), zlib.crc32(str("" if k is None else k).encode()) % 5 == 1, len(run(t)) - 1, sum(w in words for w in run(t)[1:]), n,
         round(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in run(t)[1:]), 6), round(sum(math.log10(prob(a, b)) for a, b in zip(run(t), run(t)[1:])), 6))
        for k, t in rows
    )
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in kneser_ney.split_score(docs).collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-6, abs=1e-5) and a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-5)
    if source == "table":
        the = [prob("the", w) for w in words] + [prob("the", "\0")]
        assert sum(the) == pytest.approx(1)


def test_classifier_is_right_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored, model = rule_ensemble.classify(docs, labels)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == docs.count() and model.rules and model.describe()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert all(0 < r.score < 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())


def test_classifier_takes_odd_rows(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (4, 7, 0), (6, 1, 0)], none.schema)
    for labels in (none, odd):
        scored, _ = rule_ensemble.classify(frame(ODD, extra=[("stats", "x"), ("score", "y")]), labels)
        assert scored.count() == len(ODD) and scored.where("score is null or score < 0 or score > 1").count() == 0
    docs = frame(ODD, extra=[("stats", "x"), ("key", "y")])
    kept = rule_ensemble.keep_good(docs, docs, odd)
    assert kept.columns == docs.columns
    assert rule_ensemble.classify(frame([]), odd)[0].count() == 0


def test_rules_are_shortened_and_evaluated(spark):
    rule = rule_ensemble.shortened(((0, True, 9.0), (1, False, 2.0), (0, True, 5.0), (1, False, 3.0)))
    assert rule == ((0, True, 5.0), (1, False, 3.0))
    names = rule_ensemble.STATISTICS
    df = spark.createDataFrame([((4.0, 3.5),), ((6.0, 3.5),), ((4.0, 3.0),)], f"s struct<{names[0]}: double, {names[1]}: double>")
    model = rule_ensemble.RuleModel([(2.0, rule)], -1.0)
    got = [r[0] for r in df.select(model.score("s")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e), 1 / (1 + math.e)])


def test_catalog_has_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 14))
