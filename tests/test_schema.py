"""Shaping of prompts and generations."""

import pytest
from pyspark.sql import functions as F

from answerproof.operators import schema

PROMPT = "What is the capital of France?"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Paris.", "Paris"),
        ("Answer: Paris.\nBecause", "Paris"),
        ("thinking\naNSWER:\n\n  Paris . .\nmore", "Paris"),
        ("Answer: Answer: Paris", "Answer: Paris"),
        ("\n  \n First line \n second", "First line"),
        (PROMPT + " Paris", "Paris"),
        (PROMPT, ""),
        ("Answer:", ""),
        ("Answer:   \n ", ""),
        ("...", ""),
        ("", ""),
        (None, ""),
        ("a b", "a"),
        ("a\x0bb", "a"),
        ("3.14.", "3.14"),
        ("no answer here", "no answer here"),
    ],
)
def test_clean_response(spark, raw, want):
    df = spark.createDataFrame([(raw, PROMPT)], "raw string, prompt string")
    assert df.select(schema.clean_response("raw", "prompt")).first()[0] == want


def test_coerce_id(spark):
    told = ["7", " 8 ", "9.9", "-3.7", "1e3", "x", "", None, "12d", "9007199254740993", "1_0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", schema.coerce_id("t")).collect())]
    assert got == [7, 8, 9, -3, 1000, 0, 0, 0, 0, 9007199254740993, 0]


def test_template_from_path(spark):
    paths = ["a/prompts_riddle.csv", "hard_prompts1.csv", "x/prompts_.csv", "my_prompts_a_b.v2.csv"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = [r[1] for r in sorted(df.select("i", schema.template_from_path("p")).collect())]
    assert got == ["riddle", "hard_prompts1", "prompts_", "a_b.v2"]


def prompts(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).withColumns(
        {"source": F.lit("dir/prompts_x.csv"), schema.POSITION: F.monotonically_increasing_id()}
    ).coalesce(1)


def ids(df):
    return [(r["id"], r["prompt"]) for r in df.orderBy(schema.POSITION).collect()]


def test_aliases_in_any_case_and_template_from_name(spark):
    df = schema.normalize_prompts(prompts(spark, [("q1", "a1")], ["Question", "GOLD"]))
    row = df.first()
    assert (row["template"], row["id"], row["prompt"], row["correct_answer"]) == ("x", 1, "q1", "a1")


def test_canonical_header_wins_over_aliases(spark):
    df = schema.normalize_prompts(prompts(spark, [("no", "yes", "a")], ["text", "prompt", "label"]))
    assert df.first()["prompt"] == "yes"


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="correct_answer"):
        schema.normalize_prompts(prompts(spark, [("q",)], ["prompt"]))


def test_generated_ids_keep_gaps_of_blank_prompts(spark):
    df = prompts(spark, [("a", "1"), (" ", "1"), ("c", "1")], ["prompt", "answer"])
    assert ids(schema.normalize_prompts(df)) == [(1, "a"), (3, "c")]


def test_two_bad_ids_renumber_the_whole_source(spark):
    df = prompts(spark, [("10", "a", "1"), ("x", "b", "1"), ("y", "c", "1")], ["qid", "prompt", "answer"])
    assert ids(schema.normalize_prompts(df)) == [(1, "a"), (2, "b"), (3, "c")]


def test_one_bad_id_is_zero(spark):
    df = prompts(spark, [("10", "a", "1"), ("x", "b", "1")], ["qid", "prompt", "answer"])
    assert ids(schema.normalize_prompts(df)) == [(10, "a"), (0, "b")]


def test_only_sources_with_repeats_are_renumbered(spark):
    rows = [("a", 5, 1), ("a", 5, 2), ("b", 9, 3), ("b", 7, 4), (None, 1, 5), (None, 1, 6)]
    df = spark.createDataFrame(rows, f"source string, id bigint, {schema.POSITION} bigint")
    got = schema.resequence_duplicate_ids(df).orderBy(schema.POSITION).select("source", "id").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("a", 2), ("b", 9), ("b", 7), (None, 1), (None, 2)]


def test_a_run_with_repeated_keys_is_left_out(spark):
    left = spark.createDataFrame([("r1", 1, "p"), ("r1", 2, "p"), ("r2", 1, "p"), ("r3", 1, "p")],
                                 "run string, id int, prompt string")
    right = spark.createDataFrame([("r1", 1, "x"), ("r2", 1, "y"), ("r2", 1, "z"), ("r9", 1, "w")],
                                  "run string, id int, model_response_raw string")
    got = schema.attach_generations(left, right).orderBy("run", "id").collect()
    assert [(r["run"], r["id"], r["model_response_raw"]) for r in got] == [
        ("r1", 1, "x"), ("r1", 2, None), ("r3", 1, None)
    ]


def test_features(spark):
    df = spark.createDataFrame([("äb", None, " Yes "), ("c", "xyz", "1.0")],
                               "prompt string, model_response string, hallucinated string")
    got = schema.add_features(df, nan_length=3).select(
        "prompt_length", "response_length", "hallucinated", "is_correct").collect()
    assert [tuple(r) for r in got] == [(2, 3, True, 0), (1, 3, False, 1)]


def test_validate_prompts(spark):
    ok = spark.createDataFrame([("",), ("q",)], "text string")
    blank = spark.createDataFrame([(" ",), (None,)], "prompt string")
    other = spark.createDataFrame([("q",)], "other string")
    assert schema.validate_prompts(ok).first()["ok"] is True
    assert schema.validate_prompts(blank).first()["ok"] is False
    assert "no column named" in schema.validate_prompts(other).first()["message"]


def test_wrapped_prompt_ends_with_the_question(spark):
    df = spark.createDataFrame([("Who?",)], "q string")
    assert df.select(schema.wrap_prompt("q")).first()[0].endswith("commentary.\nQuestion: Who?\nAnswer:")
