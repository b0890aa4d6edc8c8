"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow MLlib trees are grown on labelled rows; every path from a root becomes a
conjunctive rule; a lasso logistic regression weighs the rules and sets most weights to
zero; what is left is compiled into one Spark column expression, so scoring runs JVM-side
over the stored statistics.

Defined results: a null or empty text has zero words and gets statistics of zero, and so a
score like any other text; labels that are null, neither 0 nor 1, or contradict each other
for a key are left out; without labelled rows of both classes the score is the share of
label 1 (one half without any). Repeated rows get equal scores.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

from . import quality_rules, textkit
from .tasks import crc_bucket, free_name, measure_texts

#: Labelled rows used for fitting, at most: those of smallest hashed key.
SAMPLE = 20_000
TREES, DEPTH, LASSO, ROUNDS = 24, 3, 0.002, 60
THRESHOLD = 0.3
CHUNK = 4096

STATISTICS = (
    "n_words", "word_length", "distinct_share", "top_word_share", "same_word_share", "short_word_share", "capital_share", "lower_share", "digit_share",
    "symbol_share", "mark_share", "bang_share", "bar_share", "foreign_share", "blank_share", "dup_line_share", "repeat_share", "words_per_line", "ratio",
)
_SETS = {name: textkit.separators(*ranges) for name, ranges in {
    "capital": ((65, 90),), "lower": ((97, 122),), "digit": ((48, 57),), "bang": ((33, 33),), "bar": ((124, 124),), "foreign": ((128, 255),),
    "mark": ((33, 34), (39, 41), (44, 47), (58, 59), (63, 63)),
}.items()}


def statistics(raw: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch | None = None) -> list[np.ndarray]:
    """The STATISTICS of each text."""
    n = len(offs) - 1
    words = textkit.find_words(raw, offs, textkit.BLANKS)
    text, count, size = words.text_of(), np.diff(words.first), np.diff(offs)
    over = lambda a, b: a / np.maximum(b, 1)
    share = lambda table: over(textkit.sums_by_text(table[raw], offs), size)
    per_word = lambda flags: over(textkit.sums_by_text(flags, words.first), count)
    lengths = words.ends - words.starts
    keys, at, times = np.unique(textkit.mix(words.hashes + text.astype(np.uint64) * textkit._BASE), return_index=True, return_counts=True)
    distinct, most = np.bincount(text[at], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, text[at], times)
    same = np.zeros(len(text), dtype=bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    newlines = textkit.sums_by_text(raw == 10, offs)
    pack = zstandard.ZstdCompressor(level=1).compress
    data = memoryview(np.ascontiguousarray(raw))
    # In chunks, so that the ratio of a long text is no higher for its length.
    packed = lambda a, b: sum(len(pack(data[i : min(b, i + CHUNK)])) for i in range(a, b, CHUNK))
    ratio = np.array([(b - a) / packed(a, b) if b > a else 0.0 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
    return [
        count, per_word(lengths), over(distinct, count), over(most, count), per_word(same), per_word(lengths <= 3), share(_SETS["capital"]), share(_SETS["lower"]), share(_SETS["digit"]),
        share(quality_rules._SYMBOLS), share(_SETS["mark"]), share(_SETS["bang"]), share(_SETS["bar"]), share(_SETS["foreign"]), share(textkit.BLANKS),
        over(quality_rules.duplicate_lines(raw, offs, words), newlines + 1), over(quality_rules.repeated_words(words, 4), count), over(count, newlines + 1), ratio,
    ]


def with_statistics(docs: DataFrame, into: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    return measure_texts(docs, statistics, ", ".join(f"{s} double" for s in STATISTICS), into, text, carry)


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """Paths of a tree (nodes of the JVM model): (statistic, at most?, bound) conditions."""
    found = [path] if path else []
    if "InternalNode" in node.getClass().getSimpleName():
        split = node.split()
        at, bound = int(split.featureIndex()), float(split.threshold())
        found += tree_rules(node.leftChild(), (*path, (at, True, bound)))
        found += tree_rules(node.rightChild(), (*path, (at, False, bound)))
    return found


def shortened(rule: Rule) -> Rule:
    """The same rule with one bound per statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for at, below, bound in rule:
        old = best.get((at, below), bound)
        best[at, below] = min(old, bound) if below else max(old, bound)
    return tuple(sorted((at, below, bound) for (at, below), bound in best.items()))


def condition(rule: Rule, stats: str) -> Column:
    side = lambda at, below, bound: F.col(f"{stats}.{STATISTICS[at]}") <= bound if below else F.col(f"{stats}.{STATISTICS[at]}") > bound
    return reduce(lambda a, b: a & b, (side(*c) for c in rule))


class RuleModel:
    """Weighted rules; `score` is their column expression."""

    def __init__(self, rules: list[tuple[float, Rule]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, stats: str) -> Column:
        terms = (F.when(condition(rule, stats), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.rules)
        total = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        name = lambda at, below, bound: f"{STATISTICS[at]} {'<=' if below else '>'} {bound:.6g}"
        return [f"{w:+.4f}  {' and '.join(name(*c) for c in rule)}" for w, rule in sorted(self.rules, key=lambda x: -abs(x[0]))]


def labelled(measured: DataFrame, labels: DataFrame, stats: str, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, label, statistics) of the rows that may teach: crc32(key) mod 5 is not 0."""
    wanted = labels.where(f"`{label}` in (0, 1)").groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    wanted = wanted.where("low = high").select("key", F.col("low").cast("double").alias("label"))
    rows = measured.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{stats}`.{s}").alias(s) for s in STATISTICS])
    return rows.join(wanted, "key").where(crc_bucket(F.col("key"), 5) != 0)


def fit(teaching: DataFrame, sample: int = SAMPLE, seed: int = 7) -> RuleModel:
    """Rules and weights from at most `sample` labelled rows."""
    rows = cut_lineage(teaching.orderBy(F.xxhash64("key"), "key").limit(sample).coalesce(1))
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return RuleModel([], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    features = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.6, minInstancesPerNode=5, seed=seed).fit(features.transform(rows))
    rules = sorted({shortened(r) for t in forest.trees for r in tree_rules(t._call_java("rootNode"))})
    if not rules:
        share = seen[1.0] / (seen[0.0] + seen[1.0])
        return RuleModel([], float(np.log(share / (1 - share))))
    stats = free_name(rows, "stats")
    fired = rows.select("label", F.struct(*STATISTICS).alias(stats)).select("label", *[condition(r, stats).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired)
    lasso = LogisticRegression(labelCol="label", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=ROUNDS).fit(vectors.select("label", "features"))
    weights = lasso.coefficients.toArray()
    return RuleModel([(float(w), r) for w, r in zip(weights, rules) if w], float(lasso.intercept))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, RuleModel]:
    """Per row: key, held_out, score, predicted; and the fitted model. Texts are read once:
    the statistics are stored, and the labels are joined to them."""
    measured = cut_lineage(with_statistics(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")), "stats", carry=[key]))
    model = fit(labelled(measured, labels, "stats", key))
    k = F.col(f"`{key}`")
    scored = measured.select(k, (crc_bucket(k, 5) == 0).alias("held_out"), model.score("stats").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)), model


def keep_good(docs: DataFrame, teaching: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; the model
    learns from the labelled rows of `teaching`."""
    known = teaching.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")).where(crc_bucket(F.col(f"`{key}`"), 5) != 0)
    # The labels meet the statistics, not the texts, which so are not shuffled.
    model = fit(labelled(with_statistics(known, "stats", carry=[key]), labels, "stats", key))
    stats = free_name(docs, "stats")
    return with_statistics(docs, stats, text).where(model.score(stats) >= THRESHOLD).drop(stats)
