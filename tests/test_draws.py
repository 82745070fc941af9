"""Counts drawn from hashes, against the exact distribution, and the split of a draw over many profiles."""

import math

import pytest
from pyspark.sql import functions as F

from answerproof.functions.draws import binomial
from answerproof.operators import resample


def mass(n, p, k):
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.3), (40, 0.2), (20, 0.5), (24, 0.5), (300, 0.04), (5_000, 0.31), (100_000, 0.0003)])
def test_drawn_counts_have_the_exact_distribution(spark, n, p):
    draws = 40_000
    text = F.concat(F.lit("t|"), F.col("id").cast("string"))
    rows = spark.range(draws).select(binomial(F.lit(n).cast("bigint"), F.lit(p), text).alias("k"))
    seen = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert sum(seen.values()) == draws and min(seen) >= 0 and max(seen) <= n
    # chi-square over counts pooled to an expectation of twenty or more
    score, cells, want, got = 0.0, 0, 0.0, 0
    reach = 12 * math.sqrt(n * p) + 30
    for k in range(int(max(0, n * p - reach)), int(min(n, n * p + reach)) + 1):
        want += draws * mass(n, p, k)
        got += seen.get(k, 0)
        if want >= 20:
            score += (got - want) ** 2 / want
            cells, want, got = cells + 1, 0.0, 0
    assert score < cells + 5 * math.sqrt(2 * cells) + 5


def test_a_draw_costs_the_same_for_any_n(spark):
    n = 4_000_000_000_000
    rows = spark.range(2_000).select(binomial(F.lit(n).cast("bigint"), F.lit(0.25), F.col("id").cast("string")).alias("k"))
    mean, sd = rows.agg(F.avg("k"), F.stddev("k")).first()
    want = math.sqrt(n * 0.25 * 0.75)
    assert abs(mean - n / 4) < 5 * want / math.sqrt(2_000) and 0.9 < sd / want < 1.1


def test_draws_repeat_whatever_the_partitions(spark):
    rows = spark.range(500).select(F.col("id"), binomial(F.col("id") + 1, F.lit(0.4), F.col("id").cast("string")).alias("k"))
    again = spark.range(500).repartition(7).select(F.col("id"), binomial(F.col("id") + 1, F.lit(0.4), F.col("id").cast("string")).alias("k"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_a_million_profiles_of_one_category(spark):
    n = 1_000_000
    profiles = spark.range(n, numPartitions=8).select(
        F.lit("a").alias("category"), F.col("id").cast("double").alias("fp"), F.lit(1.0).alias("neg"), F.lit(1).cast("bigint").alias("clusters")
    )
    drawn = resample.cluster_replicates(profiles, 2)
    plan = drawn._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan and "InPandas" not in plan
    # the last join holds the leaves of all replicates: they are spread over the tasks
    rows = {r["replicate"]: r for r in drawn.collect()}
    assert set(rows) == {-1, 0, 1} and all(r["neg"] == n for r in rows.values())
    sd = math.sqrt((n * n - 1) / 12 * n)
    assert rows[0]["fp"] != rows[1]["fp"] and all(abs(rows[r]["fp"] - rows[-1]["fp"]) < 5 * sd for r in (0, 1))


def test_numbering_of_profiles_sorts_no_category(spark):
    profiles = spark.range(100_000).select(
        F.lit("a").alias("category"), F.col("id").cast("double").alias("fp"), F.lit(1.0).alias("neg"), F.lit(2).cast("bigint").alias("clusters")
    )
    numbered, height = resample._numbered(profiles, "category")
    assert height == 17
    assert numbered.agg(F.min("__no"), F.max("__no"), F.count_distinct("__no")).first() == (0, 99_999, 100_000)


def test_no_replicates_are_refused(spark):
    with pytest.raises(ValueError):
        resample.cluster_replicates(spark.createDataFrame([("a", 1.0, 1.0, 1)], "category string, fp double, neg double, clusters long"), 0)
