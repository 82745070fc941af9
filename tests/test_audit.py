"""Sampling designs and reviewer statistics against closed forms and published figures."""

import math

import pytest
from pyspark.sql import functions as F

from answerproof.operators import audit, resample


def frame_of(spark, cells):
    """Rows for {(category, detector, label): count}."""
    rows = [(c, d, label) for (c, d, label), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "category string, detector_hallucinated boolean, final_label string")
    return df.withColumn("id", F.monotonically_increasing_id())


LEGACY = {("legacy", True, "contradiction"): 55, ("legacy", True, "supported"): 10,
          ("legacy", False, "contradiction"): 3, ("legacy", False, "supported"): 380,
          ("legacy", False, "abstention"): 2,
          ("pilot", True, "contradiction"): 10, ("pilot", True, "supported"): 64,
          ("pilot", False, "contradiction"): 1, ("pilot", False, "incomplete_or_vacuous"): 325}


def test_confusion_gives_the_published_quality(spark):
    got = {r["group"]: r for r in audit.confusion(frame_of(spark, LEGACY)).collect()}
    legacy, pilot, both = got["legacy"], got["pilot"], got["ALL"]
    assert [legacy[c] for c in ("n", "tp", "fp", "fn", "tn")] == [450, 55, 10, 3, 382]
    assert [round(legacy[c], 3) for c in ("precision", "recall", "f1")] == [0.846, 0.948, 0.894]
    assert [round(pilot[c], 3) for c in ("precision", "recall", "f1")] == [0.135, 0.909, 0.235]
    assert both["n"] == 850 and both["fp"] == 74


def test_error_labels(spark):
    got = {(r["error"], r["label"]): r["n"] for r in audit.error_labels(frame_of(spark, LEGACY)).collect()}
    assert got == {("false_positive", "supported"): 74, ("false_negative", "contradiction"): 4}


def test_wilson(spark):
    df = spark.createDataFrame([(24, 25), (14, 15), (9, 9), (1, 1), (0, 5), (0, 0)], "k int, n int")
    low, high = audit.wilson_interval(F.col("k"), F.expr("nullif(n, 0)"))
    got = [(r["k"], r["lo"] and round(r["lo"], 3), r["hi"] and round(r["hi"], 3))
           for r in df.select("k", low.alias("lo"), high.alias("hi")).collect()]
    assert got[:4] == [(24, 0.805, 0.993), (14, 0.702, 0.988), (9, 0.701, 1.0), (1, 0.207, 1.0)]
    assert got[4][1] == 0.0 and got[5][1] is None


def ratings(spark, cells):
    rows = [(g, a, b) for (g, a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "category string, rater_a string, rater_b string")


def test_kappa(spark):
    df = ratings(spark, {("x", "contradiction", "contradiction"): 20, ("x", "contradiction", "supported"): 5,
                         ("x", "supported", "contradiction"): 10, ("x", "supported", "supported"): 15,
                         ("y", "supported", "supported"): 7, ("z", "abstention", "abstention"): 3,
                         ("z", "supported", "supported"): 3})
    got = {r["group"]: r for r in audit.cohen_kappa(df).collect()}
    assert math.isclose(got["x"]["kappa"], 0.4) and got["x"]["agreement"] == 0.7
    assert got["y"]["kappa"] is None and got["z"]["kappa"] == 1.0
    assert got["ALL"]["n"] == 63 and got["ALL"]["agree"] == 48
    binary = {r["group"]: r for r in audit.cohen_kappa(df, binary=True).collect()}
    assert math.isclose(binary["x"]["kappa"], 0.4) and binary["z"]["kappa"] is None


def test_published_sampling_design(spark):
    frame = frame_of(spark, {("causal", True, "supported"): 5, ("causal", False, "supported"): 555,
                             ("citation", True, "supported"): 104, ("citation", False, "supported"): 456})
    frame = frame.withColumn("cluster_id", F.col("id") % 80).cache()
    audited = audit.audit_sample(frame, 200).cache()
    got = {r["category"]: r for r in audit.sampling_design(frame, audited).collect()}
    assert [got["causal"][f"audited_{s}"] for s in ("positives", "negatives")] == [5, 195]
    assert [got["citation"][f"audited_{s}"] for s in ("positives", "negatives")] == [104, 96]
    assert round(got["causal"]["p_negative"], 4) == 0.3514 and round(got["citation"]["p_negative"], 4) == 0.2105
    assert got["causal"]["frame_prompts"] == 80
    weights = {r["category"]: r["w"] for r in audited.groupBy("category").agg(F.sum("weight").alias("w")).collect()}
    assert all(math.isclose(w, 560) for w in weights.values())


def test_category_smaller_than_its_audit_size(spark):
    frame = frame_of(spark, {("a", True, "x"): 30, ("a", False, "x"): 5, ("b", True, "x"): 3, ("b", False, "x"): 2})
    got = audit.audit_sample(frame, 10).groupBy("category", "detector_hallucinated").count().collect()
    assert {tuple(r) for r in got} == {("a", True, 30), ("b", True, 3), ("b", False, 2)}


@pytest.mark.parametrize(
    "pos, neg, n, want",
    [(500, 500, 101, (50, 51)), (10, 500, 100, (10, 90)), (500, 10, 100, (90, 10)),
     (10, 20, 100, (10, 20)), (0, 500, 60, (0, 60)), (50, 50, 100, (50, 50))],
)
def test_balanced_sample_sizes(spark, pos, neg, n, want):
    df = spark.range(pos + neg).withColumn("detector_hallucinated", F.col("id") < pos)
    rows = audit.balanced_sample(df, n, ["id"]).collect()
    flags = [r["detector_hallucinated"] for r in rows]
    assert (flags.count(True), flags.count(False)) == want and len({r["id"] for r in rows}) == len(rows)


def test_sample_order_is_mixed_and_repeatable(spark):
    df = spark.range(1000).withColumn("detector_hallucinated", F.col("id") % 2 == 0)
    first = [r["id"] for r in audit.balanced_sample(df, 60, ["id"]).collect()]
    again = [r["id"] for r in audit.balanced_sample(df.repartition(13), 60, ["id"]).collect()]
    other = [r["id"] for r in audit.balanced_sample(df, 60, ["id"], seed=1).collect()]
    assert first == again != other
    assert 0 < sum(i % 2 for i in first[:20]) < 20


def test_file_pool_stops_after_both_goals(spark):
    rows = [(f"f{f:02d}", i < 10) for f in range(20) for i in range(20)]
    df = spark.createDataFrame(rows, "source_file string, detector_hallucinated boolean")
    assert audit.pool_goals(60) == (60, 60) and audit.pool_goals(10) == (30, 30)
    assert sorted(r[0] for r in audit.file_pool(df, 60).select("source_file").collect()) == [
        f"f{f:02d}" for f in range(6)
    ]
    assert audit.pool_rows(df, 60).count() == 120


def test_audit_rows_need_their_columns(spark):
    with pytest.raises(ValueError, match="model_response"):
        audit.audit_rows(spark.createDataFrame([("q",)], "prompt string"))
    full = spark.createDataFrame([("q", "a", "r", "yes", "f")],
                                 "prompt string, correct_answer string, model_response string, hallucinated string, source_file string")
    assert audit.audit_rows(full).first()["detector_hallucinated"] is True


def test_structure_and_composition(spark):
    rows = [("a", "p1", "r1", True, "m1"), ("a", "p1", "r1", False, "m1"), ("b", "p1", "r2", True, "m2"), ("b", "p2", None, False, "m1")]
    df = spark.createDataFrame(rows, "category string, prompt string, model_response string, detector_hallucinated boolean, model string")
    got = {r["group"]: (r["n"], r["prompts"], r["pairs"], r["positives"]) for r in audit.audit_structure(df).collect()}
    assert got == {"a": (2, 1, 1, 1), "b": (2, 2, 2, 1), "ALL": (4, 2, 3, 2)}
    cells = {r["model"]: (r["a"], r["b"]) for r in audit.composition(df, ["a", "b"]).collect()}
    assert cells == {"m1": ("1/1", "0/1"), "m2": ("0/0", "1/0")}


# ---- resampling -----------------------------------------------------------------------------


def binomial_quantile(n, k, u):
    total = 0.0
    for s in range(n + 1):
        total += math.comb(n, s) * (k / n) ** s * (1 - k / n) ** (n - s)
        if total >= u:
            return s
    return n


def test_bootstrap_inverts_the_sorted_draws(spark):
    import hashlib

    groups = {"a": (7, 30), "b": (1, 400), "c": (0, 12), "d": (5, 5), "e": (199, 200)}
    rows = [(g, i < k) for g, (k, n) in groups.items() for i in range(n)]
    df = spark.createDataFrame(rows, "run string, hallucinated boolean")
    replicates = 300
    got = {r["run"]: r for r in resample.bootstrap_rate_ci(df, ["run"], replicates, seed=3).collect()}
    low, high = resample.interval_ranks(replicates)
    for g, (k, n) in groups.items():
        draws = [int(hashlib.md5(f"3|{g}|{r}".encode()).hexdigest()[:13], 16) / 2**52 for r in range(1, replicates + 1)]
        rates = sorted(binomial_quantile(n, k, u) / n for u in draws)
        assert (got[g]["ci_low"], got[g]["ci_high"]) == (rates[low - 1], rates[high - 1]), g
        assert got[g]["hallucination_rate"] == k / n


def test_interval_ranks():
    assert resample.interval_ranks(1000) == (26, 975)
    assert resample.interval_ranks(1) == (1, 1)
    assert resample.interval_ranks(10) == (1, 9)


def test_bootstrap_of_a_large_group_is_nearly_normal(spark):
    n, k = 4_000_000, 1_000_000
    df = spark.range(n).select(F.lit("x").alias("run"), (F.col("id") < k).alias("hallucinated"))
    row = resample.bootstrap_rate_ci(df, ["run"], 2000).first()
    sd = math.sqrt(0.25 * 0.75 / n)
    assert abs(row["ci_low"] - (0.25 - 1.96 * sd)) < 0.25 * sd
    assert abs(row["ci_high"] - (0.25 + 1.96 * sd)) < 0.25 * sd




def test_cluster_bootstrap_against_all_resamples(spark):
    rows = [("a", 0, True, "supported", 1.0), ("a", 0, False, "supported", 2.0), ("a", 1, False, "supported", 2.0),
            ("a", 2, True, "supported", 1.0), ("a", 2, True, "contradiction", 1.0)]
    audited = spark.createDataFrame(rows, "category string, cluster_id int, detector_hallucinated boolean, final_label string, weight double")
    # cluster 3 is in the frame only
    frame = spark.createDataFrame([("a", c) for c in (0, 0, 1, 2, 3)], "category string, cluster_id int")
    profiles = resample.cluster_profiles(frame, audited)
    assert {tuple(r) for r in profiles.collect()} == {("a", 1.0, 3.0, 1), ("a", 0.0, 2.0, 1), ("a", 1.0, 1.0, 1), ("a", 0.0, 0.0, 1)}

    import itertools
    from collections import Counter

    values = [(1.0, 3.0), (0.0, 2.0), (1.0, 1.0), (0.0, 0.0)]
    exact = Counter()
    for draw in itertools.product(values, repeat=4):
        exact[(sum(v[0] for v in draw), sum(v[1] for v in draw))] += 1 / 256
    drawn = resample.cluster_replicates(profiles, 8000, seed=1).filter("replicate >= 0")
    seen = {(r["fp"], r["neg"]): r["n"] / 8000 for r in drawn.groupBy("fp", "neg").agg(F.count("*").alias("n")).collect()}
    assert set(seen) <= set(exact)
    assert all(abs(seen.get(v, 0) - p) < 0.02 for v, p in exact.items())

    got = {r["group"]: r for r in resample.cluster_bootstrap_fpr(frame, audited, 2000).collect()}
    assert math.isclose(got["a"]["fpr"], 2 / 6) and math.isclose(got["ALL"]["fpr"], 2 / 6)
    assert got["a"]["ci_low"] <= got["a"]["fpr"] <= got["a"]["ci_high"]
    assert math.isclose(got["a"]["specificity"], 4 / 6)


def test_replicates_do_not_depend_on_partitioning(spark):
    profiles = spark.createDataFrame([("a", 1.0, 2.0, 5), ("a", 0.0, 1.0, 9), ("b", 1.0, 1.0, 3)],
                                     "category string, fp double, neg double, clusters bigint")
    one = resample.cluster_replicates(profiles, 1200).collect()
    two = resample.cluster_replicates(profiles.repartition(5), 1200).coalesce(1).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 2 * 1201


def prompt_set(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 7).alias("id"), F.concat(F.lit("q"), "id").alias("prompt"))


@pytest.mark.parametrize("n, total", [(50, 20), (50, 50), (20, 50), (3, 1), (1, 4)])
def test_resize(spark, n, total):
    rows = resample.resize_prompts(prompt_set(spark, n), total, "pos").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, total + 1))
    names = [r["prompt"] for r in rows]
    if total <= n and total < n:
        assert len(set(names)) == total
    else:
        assert names[:n] == [f"q{i}" for i in range(n)] and set(names) <= set(names[:n])


def test_resize_refuses_an_empty_set(spark):
    with pytest.raises(ValueError):
        resample.resize_prompts(prompt_set(spark, 0), 5, "pos")
