"""Rates, correlations and keywords against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from answerproof.config import KEYWORD_STOPWORDS
from answerproof.operators import keywords, rates


def test_rate_of_nothing_is_null(spark):
    row = rates.rate(spark.createDataFrame([], "hallucinated boolean")).first()
    assert row["hallucination_rate"] is None and row["n"] == 0


def test_missing_template_is_a_group(spark):
    df = spark.createDataFrame([(None, True), ("a", False), ("a", True), (None, True)], "template string, hallucinated boolean")
    got = [tuple(r) for r in rates.rate_by_template(df).collect()]
    assert got == [(None, 1.0), ("a", 0.5)]


def test_grouping_sets_tell_totals_from_missing_values(spark):
    df = spark.createDataFrame(
        [("m", "r1", None, True), ("m", "r1", "c", False), ("m", "r2", "c", True)],
        "model string, run string, category string, hallucinated boolean",
    )
    got = {(r["level"], r["run"], r["category"]): r["n"] for r in rates.rate_grouping_sets(df).collect()}
    assert got == {
        ("category", "r1", None): 1, ("category", "r1", "c"): 1, ("category", "r2", "c"): 1,
        ("run", "r1", None): 2, ("run", "r2", None): 1, ("model", None, None): 3,
    }


def test_coverage(spark):
    rows = [("", False)] * 2 + [("x", True)] + [("y", False)] * 2
    df = spark.createDataFrame(rows, "model_response string, hallucinated boolean")
    row = rates.coverage(df).first()
    assert row["coverage"] == 0.6 and row["hallucination_rate"] == 0.2
    assert math.isclose(row["rate_if_answered"], 1 / 3)


def test_correlation_of_constants_is_null(spark):
    rows = [(i, 7, i % 2 == 0, float(-i)) for i in range(10)]
    df = spark.createDataFrame(rows, "prompt_length int, response_length int, hallucinated boolean, contains_x double")
    got = {(r["x"], r["y"]): r["r"] for r in rates.correlation_matrix(df).collect()}
    assert len(got) == 16
    assert got[("response_length", "prompt_length")] is None
    assert math.isclose(got[("prompt_length", "contains_x")], -1.0)
    assert got[("hallucinated", "prompt_length")] == got[("prompt_length", "hallucinated")]


def test_extremes(spark):
    rows = [("r", t, i < k) for t, k, n in (("a", 1, 1), ("b", 1, 4), ("c", 0, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, template string, hallucinated boolean")
    got = {r["template"]: (r["hallucinations"], r["n"], r["rank_high"], r["rank_low"])
           for r in rates.template_extremes(df, top=1).collect()}
    assert got == {"a": (1, 1, 1, 3), "c": (0, 2, 3, 1)}


VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu the of and élan x 2nd".split()


def python_keywords(rows, top_n):
    docs = [(label, [t for t in re.findall(r"\b[a-zA-Z]{2,}\b", text.lower()) if t not in KEYWORD_STOPWORDS])
            for text, label in rows]
    total, df = Counter(), Counter()
    for _, toks in docs:
        total.update(toks)
        df.update(set(toks))
    vocab = sorted(total, key=lambda t: (-total[t], t))[: 5 * top_n]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
    sums, positives = Counter({t: 0.0 for t in vocab}), sum(label for label, _ in docs)
    for label, toks in docs:
        cells = {t: n * idf[t] for t, n in Counter(toks).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in cells.values()))
        for t, v in cells.items():
            sums[t] += label * v / norm
    return sorted(((t, s / positives) for t, s in sums.items()), key=lambda p: (-round(p[1], 12), p[0]))[:top_n]


@pytest.mark.parametrize("top_n", [1, 2, 3])
def test_keywords(spark, top_n):
    rng = random.Random(top_n)
    rows = [(" ".join(rng.choices(VOCABULARY, weights=range(1, len(VOCABULARY) + 1), k=rng.randrange(0, 9))),
             rng.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "id int, prompt string, hallucinated boolean")
    want = python_keywords(rows, top_n)
    got = [tuple(r) for r in keywords.tfidf_keywords(df, top_n).collect()]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want))
    found = {r["keyword"]: (r["hallucination_rate"], r["n"]) for r in keywords.rate_by_keyword(df, top_n).collect()}
    for k, _ in want:
        hits = [h for t, h in rows if re.search(rf"\b{k}\b", t, re.I)]
        assert math.isclose(found[k][0], sum(hits) / len(hits)) and found[k][1] == len(hits)


def test_no_positives_no_keywords(spark):
    df = spark.createDataFrame([(1, "alpha beta", False)], "id int, prompt string, hallucinated boolean")
    assert keywords.tfidf_keywords(df).count() == 0 and keywords.rate_by_keyword(df).count() == 0


def test_case_and_word_boundaries(spark):
    df = spark.createDataFrame([(1, "Alpha, ALPHAS alpha1 élalpha", True)], "id int, prompt string, hallucinated boolean")
    assert {r["keyword"] for r in keywords.tfidf_keywords(df).collect()} == {"alpha", "alphas"}
    assert df.select(F.size(keywords.words("prompt"))).first()[0] == 2
