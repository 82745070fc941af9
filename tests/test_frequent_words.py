"""The vocabulary by frequency summary against the full count, and what the keyword plans evaluate."""

import random
import re

import pytest
from pyspark.sql import functions as F

from answerproof.operators import keywords


def full_count(df, size):
    counts = keywords._counted_words(df, "prompt", keywords.KEYWORD_STOPWORDS)
    return [tuple(r) for r in counts.orderBy(F.desc("total"), "term").limit(size).collect()]


def listed(df, size, tracked):
    got = keywords.vocabulary(df, size, tracked=tracked).orderBy(F.desc("total"), "term")
    return [tuple(r) for r in got.select("term", "total", "df").collect()]


def names(n):
    return ["".join(chr(97 + int(c)) for c in f"{i:04d}") for i in range(n)]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    words = names(4_000)
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=60)),) for _ in range(2_000)]
    return spark.createDataFrame(rows, "prompt string").repartition(5).cache()


def counting(monkeypatch):
    """How often all words are counted."""
    calls = []
    inner = keywords._counted_words
    monkeypatch.setattr(keywords, "_counted_words", lambda *a: calls.append(len(a) > 3) or inner(*a))
    return calls


def test_skewed_words_are_proven_without_a_full_count(skewed, monkeypatch):
    want = full_count(skewed, 10)
    calls = counting(monkeypatch)
    assert listed(skewed, 10, 2_048) == want
    assert calls == [True]


def test_flat_counts_are_counted_in_full(spark, monkeypatch):
    rows = [(" ".join(names(300)),), (" ".join(names(20)),)]
    df = spark.createDataFrame(rows, "prompt string")
    want = full_count(df, 10)
    calls = counting(monkeypatch)
    assert listed(df, 10, 64) == want
    assert calls[-1] is False


@pytest.mark.parametrize("tracked", [8, 32, 256, 65_536])
@pytest.mark.parametrize("size", [1, 5, 40])
def test_any_summary_gives_the_list_of_the_full_count(skewed, size, tracked):
    assert listed(skewed, size, tracked) == full_count(skewed, size)


def test_no_word_outside_the_candidates_exceeds_the_bound(skewed):
    counts = {r[0]: r[1] for r in full_count(skewed, 10_000)}
    for tracked in (16, 64, 512):
        candidates, others = keywords._frequent_words(skewed, 5, "prompt", keywords.KEYWORD_STOPWORDS, tracked)
        assert max(n for t, n in counts.items() if t not in candidates) <= others


def test_the_exact_pass_shuffles_candidates_only(skewed):
    few = keywords._counted_words(skewed, "prompt", (), names(20))
    partials = few._jdf.queryExecution().executedPlan().toString()
    # the filter on the candidates is below the exchange, on the words themselves
    assert partials.index("Exchange") < partials.index("INSET" if "INSET" in partials else " IN (")
    assert few.count() == 20


def test_words_are_found_once_for_each_positive_row(spark, tmp_path):
    text = spark.createDataFrame([(i, "alpha beta gamma delta " * 3) for i in range(20)], "id int, prompt string")
    text.write.parquet(str(tmp_path / "t"))
    told = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "id int, hallucinated boolean")
    told.write.parquet(str(tmp_path / "l"))
    rows = spark.read.parquet(str(tmp_path / "t")).join(spark.read.parquet(str(tmp_path / "l")), "id", "left")
    plan = keywords.tfidf_keywords(rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(keywords.WORD) == 1
    # labels are joined before words are looked for
    assert plan.index(keywords.WORD) < plan.index("Join")
    counted = keywords._counted_words(rows, "prompt", ())._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count(keywords.WORD) == 1


def test_a_lambda_over_the_vocabulary_holds_no_pattern(spark):
    df = spark.createDataFrame([("alpha beta", True), ("beta gamma", False)], "prompt string, hallucinated boolean")
    plan = keywords.tfidf_keywords(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    # the pattern is an argument of the outer transform, in front of the function that is applied to it
    assert re.search(r"transform\(array\(struct\(toks, .*regexp_extract_all", plan)
