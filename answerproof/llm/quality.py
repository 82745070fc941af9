"""Anomalous documents by an isolation forest over rule statistics.

The counts the rules need are taken once from every whole text. Random splits of small samples isolate
unusual rows after few steps; the score is 2 to the power of minus the mean path length over its
expectation. Each split on a path also credits its statistic with what it isolated, and the statistic
with most credit is the reason. What is unusual is not always bad, so every reason has a threshold of
its own, set on a histogram of the scores of all labelled rows. The forest is fitted on a bounded
sample (``FIT_ROWS`` rows by the hash of their id).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.session import written

WINDOW = 5
TREES, SAMPLE = 150, 256
BINS = 1_000
FIT_ROWS = 9_600
FALSE_COST = 4  # bad rows that a threshold must catch for each good row it rejects
SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars_all", "n_upper", "n_digits", "n_letters", "n_lines", "n_distinct", "n_bang")
REASONS = (
    "symbols", "repeated lines", "repeated words", "word length", "capitals", "digits", "letters",
    "distinct words", "exclamations",
)
STATS = ", ".join(f"{c} long" for c in BASE + MORE)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a five-word window found twice or more, the first one included."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def statistics(text: str) -> tuple[int, ...]:
    words = common.WORD.findall(text)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if common.WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    low = text.lower()
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        dup,
        repeated_words(words),
        len(text),
        sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))) if low != text else 0,
        sum(map(len, re.findall(r"[0-9]+", text))),
        letters,
        lines,
        len(set(words)),
        text.count("!") + text.count("?"),
    )


def rule_statistics(text: pd.Series) -> pd.DataFrame:
    rows = [statistics(t) for t in common.texts_of(text)]
    return pd.DataFrame(rows, columns=list(BASE + MORE), dtype="int64")


def features(stats: pd.DataFrame) -> np.ndarray:
    """Shares, comparable over texts of any length; rare events in logarithms, as most shares are 0."""
    s = stats.astype(float)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_chars_all"], 1)
    lines = np.maximum(s["n_lines"], 1)
    expected = np.minimum(1.0, 12 / np.sqrt(words))  # distinct words thin out with length
    return np.column_stack(
        [
            np.log1p(100 * s["n_symbols"] / chars),
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["word_chars"] / words,
            np.log1p(100 * s["n_upper"] / chars),
            np.log1p(100 * s["n_digits"] / chars),
            s["n_letters"] / chars,
            np.minimum(s["n_distinct"] / words / np.maximum(expected, 1e-9), 2.0),
            np.log1p(100 * s["n_bang"] / words),
        ]
    )


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: feature (-1: leaf), split, left and right child, depth plus remainder, rows."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.trees = []
        self.expected = max(_c(min(sample, len(rows))), 1e-9)
        limit = int(np.ceil(np.log2(max(2, min(sample, len(rows))))))
        for _ in range(trees if len(rows) else 0):
            part = rows[draw.choice(len(rows), min(sample, len(rows)), replace=False)]
            nodes: list[list[float]] = []

            def grow(at: np.ndarray, depth: int, nodes=nodes) -> int:
                me = len(nodes)
                nodes.append([-1, 0.0, 0, 0, depth + _c(len(at)), len(at)])
                low, high = at.min(axis=0), at.max(axis=0)
                wide = np.flatnonzero(high > low)
                if depth >= limit or len(at) <= 1 or not len(wide):
                    return me
                f = int(draw.choice(wide))
                split = draw.uniform(low[f], high[f])
                left = at[:, f] < split
                if left.all() or not left.any():
                    left = at[:, f] < high[f]
                    split = high[f]
                nodes[me][:2] = [f, split]
                nodes[me][2] = grow(at[left], depth + 1)
                nodes[me][3] = grow(at[~left], depth + 1)
                return me

            grow(part, 0)
            self.trees.append(np.array(nodes))

    def scores(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score, 0 to 1, higher for rows that are isolated sooner (0.5 without trees), and reason."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5), np.zeros(len(rows), int)
        total = np.zeros(len(rows))
        credit = np.zeros(rows.shape)
        for tree in self.trees:
            feature, child = tree[:, 0].astype(int), tree[:, 2:4].astype(int)
            at = np.arange(len(rows))  # rows that have not reached a leaf
            node = np.zeros(len(rows), int)
            while len(at):
                inner = feature[node] >= 0
                total[at[~inner]] += tree[node[~inner], 4]
                at, node = at[inner], node[inner]
                f = feature[node]
                side = (rows[at, f] >= tree[node, 1]).astype(int)
                below = child[node, side]
                credit[at, f] += np.log2(tree[node, 5] / tree[below, 5])
                node = below
        return 2.0 ** (-total / len(self.trees) / self.expected), credit.argmax(axis=1)


def thresholds(histogram: list[tuple[int, int, int, int]]) -> dict[int, float]:
    """Score from which a row is rejected, for each reason, from rows (reason, bin, bad, good) over all
    labelled rows: where bad rows above it outweigh good ones most, a good one counting
    ``FALSE_COST`` times. Reasons without such a place reject nothing."""
    out = {}
    for reason in {h[0] for h in histogram}:
        gain = best = 0
        for _, b, bad, good in sorted((h for h in histogram if h[0] == reason), reverse=True):
            gain += bad - FALSE_COST * good
            if gain > best:
                best, out[reason] = gain, b / BINS
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, anomaly (score) and reason, one row for each row of ``docs``.

    A missing text counts as no words. ``labels``: doc_id, quality (1 good, 0 bad; others are skipped).
    Without labelled rows only the base rules reject. Repeated rows are judged alike.
    """
    stats = docs.select("doc_id", F.pandas_udf(rule_statistics, STATS)("text").alias("s")).select("doc_id", "s.*")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", base_failed), "rule-statistics")
    columns = list(BASE + MORE)
    # a sample of fixed size of those the base rules pass, by a hash of the id: copies of one text have
    # ids of their own and enter like any other rows, and repeated rows are one
    order = [F.xxhash64("doc_id", F.lit("forest")), F.col("doc_id"), F.xxhash64(*columns)]
    passed = stats.filter("not base_failed").select("doc_id", *columns).dropDuplicates()
    sample = passed.orderBy(*order).limit(FIT_ROWS).toPandas()
    forest = Forest(features(sample[columns]))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("anomaly double, reason int")
    def isolate(*counts: pd.Series) -> pd.DataFrame:
        score, reason = shared.value.scores(features(pd.concat(counts, axis=1, keys=columns)))
        return pd.DataFrame({"anomaly": score, "reason": reason.astype("int32")})

    scored = stats.withColumn("f", isolate(*columns)).select("doc_id", *BASE, "base_failed", "f.*")
    scored = written(scored, "anomalies")
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    told = scored.filter("not base_failed").select(
        "doc_id", "reason", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")
    )
    histogram = (
        told.join(known, "doc_id")
        .groupBy("reason", "bin")
        .agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    )
    cuts = thresholds([tuple(r) for r in histogram.collect()])  # at most reasons times BINS rows
    cut = F.lit(2.0)
    for reason, value in sorted(cuts.items()):
        cut = F.when(F.col("reason") == reason, value).otherwise(cut)
    kept = ~F.col("base_failed") & (F.col("anomaly") < cut)
    named = F.element_at(F.array(*[F.lit(n) for n in REASONS]), F.col("reason") + 1)
    return scored.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "anomaly", named.alias("reason"))
