"""Whole jobs end to end."""

import json

import pytest
from pyspark.sql import functions as F

from answerproof.plans import jobs
from answerproof.sources import tables


def generations(spark):
    rows = [
        (1, "music", 0, json.dumps(["Who sang it?", "Who  wrote it?", "Who sang it?"])),
        (0, "law", 0, "1. Which court?\n2. Which judge?\n3. Which year?"),
        (1, "music", 1, "Here: [\"Who wrote it?\", \"Which key?\"]"),
    ]
    return spark.createDataFrame(rows, "seed_no int, seed string, attempt int, generation string")


def ballots(spark, skip=()):
    told = {"Who sang it?": ["Ann.", "Bo", "ann"], "Who wrote it?": ["Cy"], "Which key?": ["C minor"],
            "Which court?": ["High", "Low"], "Which judge?": ["X"], "Which year?": ["1984", "1984", "1985"]}
    rows = [(q, a, i) for q, answers in told.items() if q not in skip for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, "question string, answer string, vote_no int")


def test_prompt_set(spark):
    got = jobs.build_prompt_set(generations(spark), ballots(spark), 3).orderBy("id").collect()
    assert [tuple(r) for r in got] == [
        ("law", 1, "Which court?", "high"), ("law", 2, "Which judge?", "x"), ("law", 3, "Which year?", "1984"),
        ("music", 4, "Who sang it?", "ann"), ("music", 5, "Who wrote it?", "cy"), ("music", 6, "Which key?", "c minor"),
    ]
    for total in (4, 9):
        ids = [r["id"] for r in jobs.build_prompt_set(generations(spark), ballots(spark), 3, total).orderBy("id").collect()]
        assert ids == list(range(1, total + 1))


def test_incomplete_prompt_sets_are_refused(spark):
    with pytest.raises(ValueError, match="music"):
        jobs.build_prompt_set(generations(spark).filter("attempt = 0"), ballots(spark), 3)
    with pytest.raises(ValueError, match="no answer"):
        jobs.build_prompt_set(generations(spark), ballots(spark, ["Which key?"]), 3)


def test_label_job_cleans_joins_and_abstains(spark):
    prompts = spark.createDataFrame(
        [("r", 1, "t", "Capital?", "Paris"), ("r", 2, "t", "Year?", "1984"), ("r", 3, "t", "Who?", "Ann")],
        "run string, id int, template string, prompt string, correct_answer string")
    raw = spark.createDataFrame(
        [("r", 1, "Let me see.\nAnswer: Capital? London."), ("r", 2, "1984 or 1985")],
        "run string, id int, model_response_raw string")
    got = {r["id"]: r for r in jobs.label_responses(prompts, raw).collect()}
    assert (got[1]["model_response"], got[1]["reasoning"]) == ("London", "atomic_entity_mismatch")
    assert got[2]["reasoning"] == "numeric_alternative_conflict" and got[2]["hallucinated"]
    assert (got[3]["model_response"], got[3]["hallucinated"], got[3]["reasoning"]) == ("", False, "empty_response")
    assert got[1].asDict().keys() == {"run", *tables.LABELED_COLUMNS}


def test_label_job_with_scores(spark):
    prompts = spark.createDataFrame([("r", 1, "t", "Say?", "the dog lay on a rug")],
                                    "run string, id int, template string, prompt string, correct_answer string")
    raw = spark.createDataFrame([("r", 1, "the cat sat on a mat")], "run string, id int, model_response_raw string")
    scores = spark.createDataFrame([("r", 1, 0.2, 0.1, 0.9)],
                                   "run string, id int, embed_score double, nli_entail_min double, nli_contradiction_max double")
    from answerproof import Thresholds

    row = jobs.label_responses(prompts, raw, Thresholds(), scores=scores).first()
    assert row["reasoning"] == "nli_contradiction_veto" and row["baseline_embed_method"] == "embedding"


def test_audit_set(spark):
    rows = spark.range(400).select(
        F.format_string("responses_labeled_%d.csv", F.floor(F.col("id") / 100)).alias("source_file"),
        F.lit("run1").alias("run"), F.lit("t").alias("template"), F.col("id") % 100,
        F.lit("q").alias("prompt"), F.lit("a").alias("correct_answer"), F.lit("r").alias("model_response"),
        F.expr("if(id % 5 = 0, 'yes', 'no')").alias("hallucinated"),
    ).withColumnRenamed("(id % 100)", "id")
    got = jobs.audit_set(rows, 30)
    assert got.columns == ["run", "source_file", "template", "id", "prompt", "correct_answer", "model_response",
                           "detector_hallucinated", "human_hallucinated", "human_notes"]
    assert got.groupBy("detector_hallucinated").count().orderBy("detector_hallucinated").collect() == [(False, 15), (True, 15)]
    # two files hold 40 of each label's goal of 40 positives
    assert {r[0] for r in got.select("source_file").distinct().collect()} <= {"responses_labeled_0.csv", "responses_labeled_1.csv"}


def test_prompt_file_verdicts(spark, tmp_path):
    def verdict(name, content):
        if content is not None:
            (tmp_path / name).write_text(content)
        row = tables.validate_prompt_file(spark, str(tmp_path / name)).first()
        return row["ok"], row["message"]

    assert verdict("none.csv", None) == (False, "no file none.csv")
    assert verdict("empty.csv", "") == (False, "nothing in empty.csv")
    assert verdict("other.csv", "a,b\n1,2\n")[0] is False
    assert verdict("blank.csv", "prompt,b\n ,2\n") == (False, "every prompt is blank")
    assert verdict("good.csv", "text,b\nq,2\n") == (True, "ok")
