"""Distinct counts by bitmaps, sparse correlations, phrases, keyed tables, and conditions below the labels."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerproof.config import RULES_ONLY
from answerproof.operators import audit, decide, distinct, keywords, rates, schema
from answerproof.sources import keyed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_count_like_sets(spark):
    rng = random.Random(4)
    keys = [None, *map(str, range(70_000))]
    rows = [(rng.choice(["a", "b", None]), rng.choice(keys)) for _ in range(60_000)]
    rows += [("c", None)] * 3
    df = spark.createDataFrame(rows, "g string, k string").repartition(6).withColumn("d", F.md5("k"))
    bits = distinct.group_bitmaps(df, ["g"], "d").cache()
    got = {r["g"]: r["n"] for r in distinct.distinct_counts(bits, ["g"], "n").collect()}
    want = {g: len({k for x, k in rows if x == g and k is not None}) for g in ("a", "b", None)}
    assert got == want
    assert distinct.distinct_counts(bits, [], "n").first()[0] == len({k for _, k in rows if k is not None})
    # numbers are dense: two or three buckets hold fifty thousand of them
    assert bits.select("bucket").distinct().count() <= 3


def test_audit_structure_expands_nothing(spark):
    rows = [("x", "p", "r", True), ("x", "p", "r", False), ("x", "q", None, None), ("y", "p", "r", True), (None, None, "r", False)]
    df = spark.createDataFrame(rows, "category string, prompt string, model_response string, detector_hallucinated boolean")
    table = audit.audit_structure(df)
    assert "Expand" not in plan_of(table)
    got = {r["group"]: tuple(r)[1:] for r in table.collect()}
    assert got == {"x": (3, 2, 2, 1), "y": (1, 1, 1, 1), None: (1, 0, 1, 0), "ALL": (5, 2, 3, 2)}
    assert audit.audit_structure(df.limit(0)).collect()[0][:2] == ("ALL", 0)


def test_sparse_correlation_equals_the_dense_one(spark):
    rng = random.Random(1)
    names = [f"contains_{i}" for i in range(5)]
    rows = [([n for n in names[:-1] if rng.random() < 0.3] + ["elsewhere"], rng.random() * 9, rng.choice([None, 1.0, 2.0, 5.0]), rng.random() < 0.4) for _ in range(300)]
    rows += [(None, 1.0, 1.0, True), ([names[0], names[0]], 2.0, None, None)]
    df = spark.createDataFrame(rows, "had array<string>, a double, b double, hallucinated boolean")
    dense = df.withColumns({n: F.coalesce(F.array_contains("had", n), F.lit(False)).cast("double") for n in names})
    want = {(r["x"], r["y"]): r["r"] for r in rates.correlation_matrix(dense, ["a", "b", *names]).collect()}
    got = {(r["x"], r["y"]): r["r"] for r in rates.sparse_correlation(df, "had", names, ["a", "b"]).collect()}
    assert set(got) == set(want)
    for pair, r in want.items():
        assert (r is None) == (got[pair] is None), pair
        assert r is None or math.isclose(r, got[pair], abs_tol=1e-9), pair


def test_five_hundred_features_in_one_aggregation(spark):
    names = [f"contains_{i:03d}" for i in range(500)]
    rng = np.random.default_rng(3)
    had = rng.random((400, 500)) < 0.02
    df = spark.createDataFrame([([n for n, h in zip(names, row) if h], bool(row[0])) for row in had], "had array<string>, hallucinated boolean")
    got = {(r["x"], r["y"]): r["r"] for r in rates.sparse_correlation(df, "had", names).collect()}
    assert len(got) == 501**2
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(had.T.astype(float))
    for i in range(0, 500, 7):
        for j in range(0, 500, 11):
            r = got[names[i], names[j]]
            assert (r is None) == bool(np.isnan(want[i, j])) and (r is None or abs(r - want[i, j]) < 1e-9)
    assert abs(got["contains_000", "hallucinated"] - 1) < 1e-9


TEXTS = [
    "New York is not new-york; NEW YORK!", "a newyork state", "New  York", "in new york", "C++ and c++17", "c++",
    "the end-to-end test", "end to end", "", None, "Ünïcode Straße heißt so", "x.y.z", "york new york new york", "-foo bar", "a-foo bar",
]
PHRASES = ["new york", "New York", "end-to-end", "c++", "new york new", "straße heißt", "york", "x.y", "-foo", "foo bar", "..", "  ", "is not new-york; new"]


def test_phrases_equal_a_pattern_for_each(spark):
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(TEXTS * 2)], "i int, prompt string, hallucinated boolean")
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "keyword string")
    got = sorted(tuple(r) for r in keywords.phrase_matches(df, phrases, carry=("i",)).collect())
    want = sorted((i, p) for i, t in enumerate(TEXTS * 2) for p in PHRASES
                  if t and re.search(r"\w", p) and re.search(rf"\b{re.escape(p)}\b", t, re.I))
    assert got == want
    plan = plan_of(keywords.rate_by_phrase(df, phrases))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rated = {r["keyword"]: (r["hallucination_rate"], r["n"]) for r in keywords.rate_by_phrase(df, phrases).collect()}
    assert rated["york"][1] == sum(p == "york" for _, p in want)
    assert keywords.phrase_matches(df, phrases.limit(0)).count() == 0


def test_tables_kept_by_their_keys_join_without_moving(spark, tmp_path):
    rows = spark.range(2_000).selectExpr("concat('r', id % 3) as run", "'s' as source", "id", "concat('p', id) as prompt")
    answers = rows.filter("id % 7 > 0").selectExpr("run", "source", "id", "concat('a', id) as model_response_raw")
    left = keyed.save_keyed(rows, "kept_prompts", str(tmp_path / "p"), 4)
    right = keyed.save_keyed(answers, "kept_answers", str(tmp_path / "a"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = schema.attach_generations(left, right)
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        # the check of the keys needs none either
        assert "Exchange" not in plan_of(schema.one_to_one_violations(left.select(*keyed.KEYS), list(keyed.KEYS)))
        assert joined.count() == 2_000 and joined.filter("model_response_raw is null").count() == 286
        # named again by another session
        spark.sql("drop table kept_prompts")
        again = keyed.register_keyed(spark, "kept_prompts", str(tmp_path / "p"), "run string, source string, id bigint, prompt string", 4)
        assert "Exchange" not in plan_of(schema.attach_generations(again, right))
        # one file for each bucket
        assert len([f for f in (tmp_path / "p").iterdir() if f.name.startswith("part-")]) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table if exists kept_prompts")
        spark.sql("drop table if exists kept_answers")
    with pytest.raises(ValueError):
        keyed.save_keyed(rows.drop("source"), "kept_prompts", str(tmp_path / "x"), 4)


def test_conditions_on_the_table_reach_its_scan(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('r', id % 3) as run", "id", "concat('answer ', id % 5) as model_response", "'answer 1' as correct_answer")
    rows.write.partitionBy("run").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    conditions = ["run = 'r1'", "id > 30", "reason <> 'exact_match'", "id % 2 = 0 or hallucinated"]
    for job in (decide.label_pairs, decide.flag_pairs):
        some = [c for c in conditions if job is decide.label_pairs or "reason" not in c]
        table = job(stored, RULES_ONLY, where=some)
        scan = next(x for x in plan_of(table).split("\n") if "FileScan" in x)
        assert "PartitionFilters: [isnotnull(run" in scan and "GreaterThan(id,30)" in scan
        all_ = job(stored, RULES_ONLY)
        for c in some:
            all_ = all_.filter(c)
        assert sorted(map(str, table.collect())) == sorted(map(str, all_.collect())) and table.count() > 0


def test_names_in_quotes_are_no_columns():
    before, after = decide.split_conditions(["run = 'reason'", 'x = "it\'s accepted"', "REASON = 'x'", "`reason` = 'x'"], decide.DECIDED)
    assert before == ["run = 'reason'", 'x = "it\'s accepted"'] and len(after) == 2
