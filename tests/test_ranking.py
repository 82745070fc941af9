"""Numbering and picking with groups of very different size."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from answerproof.functions.flags import hash_key
from answerproof.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with two thirds of the rows, one missing key, many small ones."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 12)
    )
    return spark.range(6000, numPartitions=7).select(key.alias("k"), "id").cache()


def test_number_rows_equals_a_window(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ROWS_LOG2", 6)
    spaced = skewed.withColumn("pos", F.col("id") * 5 - 1000)
    got = ranking.number_rows(spaced, ["k"], "pos", "rn")
    want = spaced.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    both = got.join(want.select("id", "want"), "id")
    assert both.count() == 6000 and both.filter("rn != want").count() == 0


def test_number_rows_of_the_whole_table_by_hash(skewed):
    keyed = skewed.withColumn("h", hash_key(1, "id"))
    got = [r["id"] for r in ranking.number_rows(keyed, [], "h", "rn", hashed=True).orderBy("rn").collect()]
    assert got == sorted(range(6000), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())


@pytest.mark.parametrize("sorted_rows", [1_000_000, 2])
@pytest.mark.parametrize("quota", [0, 1, 37, 399, 4000, 9999])
def test_take_by_hash_equals_a_window(skewed, monkeypatch, quota, sorted_rows):
    monkeypatch.setattr(ranking, "SORTED_ROWS", sorted_rows)
    monkeypatch.setattr(ranking, "CUT_DIGITS", 1 if sorted_rows == 2 else 3)
    keyed = skewed.withColumn("h", hash_key(2, "id"))
    quotas = skewed.select("k").distinct().withColumn("q", F.lit(quota))
    got = {r["id"] for r in ranking.take_by_hash(keyed, ["k"], quotas, "q", "h").collect()}
    rn = F.row_number().over(Window.partitionBy("k").orderBy("h"))
    want = {r["id"] for r in keyed.withColumn("rn", rn).filter(F.col("rn") <= quota).collect()}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2500, 6000, 7000])
def test_take_first(skewed, n):
    keyed = skewed.withColumn("h", hash_key(3, "id"))
    got = {r["id"] for r in ranking.take_first(keyed, n, "h").collect()}
    order = sorted(range(6000), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    assert got == set(order[:n])


def test_top_k_per_group(skewed):
    got = ranking.top_k_per_group(skewed, ["k"], [F.desc("id")], 5, fan_in=3)
    rn = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("id")))
    want = skewed.withColumn("rn", rn).filter("rn <= 5")
    assert {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}


def test_top_k_prunes_before_the_shuffle(skewed):
    got = ranking.top_k_per_group(skewed, ["k"], [F.desc("id")], 5)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10)], "k string, w int")
    assert [tuple(r) for r in ranking.join_on(a, b, ["k"]).collect()] == [(None, 1, 10)]
