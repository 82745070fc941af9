"""Rows belong to files: run, source and id name them from the prompts to the audit sample."""

import pytest
from pyspark.sql import functions as F

from answerproof.functions.flags import hash_key
from answerproof.operators import audit, harvest, ranking, resample, schema
from answerproof.plans import jobs
from answerproof.sources import tables

FILES = [("r1", "prompts_a.csv"), ("r1", "prompts_b.csv"), ("r1", "prompts_c.csv"), ("r2", "prompts_a.csv")]


def _prompts(spark):
    rows = [(run, name, i, "t", f"q{i} {name}", f"gold{i}") for run, name in FILES for i in range(1, 6)]
    return spark.createDataFrame(rows, "run string, source string, id long, template string, prompt string, correct_answer string")


def _generations(prompts):
    return prompts.select("run", "source", "id", F.concat(F.lit("gold"), "id").alias("model_response_raw"))


def test_runs_of_several_files_keep_all_rows(spark):
    prompts = _prompts(spark)
    labelled = jobs.label_responses(prompts, _generations(prompts))
    assert labelled.count() == 20 and labelled.filter("hallucinated").count() == 0
    # a repeated id costs its own file only, and the file is named
    one = F.col("source") == "prompts_b.csv"
    twice = _generations(prompts).unionByName(_generations(prompts).filter(one & (F.col("id") == 2)))
    assert [tuple(r) for r in schema.left_out(prompts, twice).collect()] == [("r1", "prompts_b.csv")]
    assert jobs.label_responses(prompts, twice).count() == 15


def test_written_labels_come_back_with_run_and_source(spark, tmp_path):
    prompts = _prompts(spark)
    out = str(tmp_path / "labels")
    tables.write_labeled(jobs.label_responses(prompts, _generations(prompts)), out)
    found = [r["path"] for r in tables.discover(spark, out).collect()]
    assert found
    back = tables.read_labeled(spark, found)
    names = {(r["run"], r["source_file"]) for r in back.select("run", "source_file").distinct().collect()}
    assert names == {(run, name.replace("prompts", "responses_labeled")) for run, name in FILES}
    assert back.count() == 20


def test_files_of_one_name_in_two_runs_are_two_files(spark):
    rows = [(run, "x.csv", i, "p", "c", "m", str(i % 2 == 0)) for run in ("r1", "r2", "r3") for i in range(10)]
    df = spark.createDataFrame(rows, "run string, source_file string, id long, prompt string, correct_answer string, model_response string, hallucinated string")
    pool = audit.file_pool(audit.audit_rows(df), 1)
    assert pool.select("run", "source_file").distinct().count() == pool.count() == 3
    drawn = jobs.audit_set(df, 8)
    assert drawn.select("run", "id").distinct().count() == 8
    with pytest.raises(ValueError):
        jobs.audit_set(df, 8, keys=["source_file", "id"])


def test_long_headers_are_read_whole(spark, tmp_path):
    path = tmp_path / "wide_prompts.csv"
    more = [f"column_{i:05d}" for i in range(800)]
    path.write_text(",".join([*more, "prompt", "correct_answer"]) + "\n" + ",".join(["x"] * 800 + ["p", "c"]) + "\n")
    assert [(r["prompt"], r["correct_answer"]) for r in tables.load_prompt_sets(spark, [str(path)]).collect()] == [("p", "c")]


def test_a_failed_write_leaves_the_old_set(spark, tmp_path):
    out = str(tmp_path / "set")
    good = spark.createDataFrame([("t", 1, "p", "c")], "template string, id long, prompt string, correct_answer string")
    tables.write_prompts(good, out)
    bad = spark.range(8).select(
        F.lit("t").alias("template"), F.col("id"), F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise("p").alias("prompt"), F.lit("c").alias("correct_answer")
    )
    with pytest.raises(Exception):
        tables.write_prompts(bad, out)
    assert spark.read.csv(out, header=True).count() == 1
    tables.write_prompts(good.unionByName(good), out)
    assert spark.read.csv(out, header=True).count() == 2


def test_scores_that_are_given_are_used(spark):
    prompts = _prompts(spark)
    keys = ["run", "source", "id"]
    answers = prompts.select(*keys, F.lit("an entirely different long answer").alias("model_response_raw"))
    prompts = prompts.withColumn("correct_answer", F.lit("some reference words that are long enough"))
    scores = prompts.select(*keys, F.lit(0.9).alias("embed_score"), F.lit(0.01).alias("nli_entail_min"), F.lit(0.99).alias("nli_contradiction_max"))
    told = jobs.label_responses(prompts, answers, scores=scores)
    assert {r["reasoning"] for r in told.collect()} == {"nli_contradiction_veto"}
    with pytest.raises(ValueError):
        jobs.label_responses(prompts, answers, scores=scores.unionByName(scores))


def test_missing_flags_count_as_negative(spark):
    rows = [("a", True, "contradiction"), ("a", None, "contradiction"), ("a", None, "ok")]
    df = spark.createDataFrame(rows, "category string, detector_hallucinated boolean, final_label string")
    total = audit.confusion(df).filter(F.col("group") == audit.TOTAL).first()
    assert total["tp"] + total["fp"] + total["fn"] + total["tn"] == total["n"] == 3
    assert tuple(audit.strata_counts(df).first()) == (1, 2)
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    assert audit.balanced_sample(keyed, 3, ["id"]).count() == 3


def test_rows_without_a_position_are_numbered(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "p long")
    assert sorted(r["n"] for r in ranking.number_rows(df, [], "p", "n").collect()) == [1, 2, 3]


def test_no_replicates_no_interval(spark):
    df = spark.createDataFrame([("a", True), ("a", False)], "g string, hallucinated boolean")
    row = resample.bootstrap_rate_ci(df, ["g"], 0).first()
    assert row["hallucination_rate"] == 0.5 and row["ci_low"] is None and row["bootstrap_samples"] == 0
    record = resample.metric_records(resample.bootstrap_rate_ci(df, ["g"], 0), ["g"]).first()
    assert {k for k, v in record.asDict().items() if v is not None} == {"g", "hallucination_rate"}
    with pytest.raises(ValueError):
        resample.bootstrap_rate_ci(df, ["g"], -1)


def test_seeds_are_complete_from_the_count_on(spark):
    rows = [("a", "x"), ("a", " x "), ("a", ""), ("a", "y"), ("a", "z"), ("b", "x")]
    df = spark.createDataFrame(rows, "seed string, question string")
    assert [tuple(r) for r in harvest.incomplete_seeds(df, 2).collect()] == [("b", 1, 2)]


def test_keys_do_not_collide(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("\\N", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(hash_key(1, "x", "y").alias("h")).distinct().count() == 5


def test_hash_cuts_are_refined_however_many_groups_there_are(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CUT_DIGITS", 1)
    monkeypatch.setattr(ranking, "SORTED_ROWS", 20)
    many = spark.range(24_000).select(F.col("id").alias("k"), "id")
    hot = spark.range(24_000, 27_000).select(F.lit(-1).cast("long").alias("k"), "id")
    keyed = many.unionByName(hot).withColumn("h", hash_key(4, "id"))
    quotas = keyed.select("k").distinct().withColumn("q", F.when(F.col("k") < 0, 700).otherwise(F.col("k") % 2))
    got = ranking.take_by_hash(keyed, ["k"], quotas, "q", "h")
    want = sorted((r["h"], r["id"]) for r in hot.withColumn("h", hash_key(4, "id")).collect())[:700]
    assert {r["id"] for r in got.filter("k < 0").collect()} == {i for _, i in want}
    assert {r["id"] for r in got.filter("k >= 0").collect()} == set(range(1, 24_000, 2))


def test_missing_flags_count_as_unflagged_in_the_design(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, None)]
    df = spark.createDataFrame(rows, "category string, cluster_id int, detector_hallucinated boolean")
    got = audit.sampling_design(df, df).first()
    assert (got["frame_positives"], got["frame_negatives"]) == (1, 2)
    assert (got["audited_positives"], got["audited_negatives"]) == (1, 2)


def test_category_columns_of_any_name(spark):
    profiles = spark.createDataFrame([("x", 1.0, 2.0, 3)], "`the class` string, fp double, neg double, clusters bigint")
    drawn = resample.cluster_replicates(profiles, 4, category="the class").collect()
    assert sorted((r["replicate"], r["fp"], r["neg"]) for r in drawn) == [(i, 3.0, 6.0) for i in range(-1, 4)]
