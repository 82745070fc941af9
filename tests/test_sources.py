"""Readers and writers on real files."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from answerproof.plans import jobs
from answerproof.sources import tables

HEADER = "template,id,prompt,model_response,correct_answer,hallucinated"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimiter_is_found(spark, tmp_path, sep):
    rows = [["id", "question", "gold"], ["1", "Who is it", "Ann"], ["2", "What is it", "tea"]]
    path = put(tmp_path, "prompts_a.csv", "\n".join(sep.join(r) for r in rows) + "\n")
    assert tables.sniff_delimiter(tables.sample_file(spark, path)) == sep
    got = tables.load_prompt_sets(spark, [path]).orderBy("id").collect()
    assert [(r["template"], r["id"], r["prompt"], r["correct_answer"]) for r in got] == [
        ("a", 1, "Who is it", "Ann"), ("a", 2, "What is it", "tea")
    ]


def test_prompt_cells_are_read_as_they_are(spark, tmp_path):
    path = put(tmp_path, "p.csv", 'prompt,correct_answer\n"a, ""b""\nc",NA\nnull,\nbad,row,here\nshort\n')
    rows = tables.read_prompts(spark, path).select("prompt", "correct_answer").collect()
    assert [tuple(r) for r in rows] == [('a, "b"\nc', "NA"), ("null", ""), ("short", "")]


def test_unusable_prompt_files_are_skipped(spark, tmp_path):
    good = put(tmp_path, "prompts_good.csv", "prompt,answer\nq,a\n")
    empty = put(tmp_path, "prompts_empty.csv", "")
    other = put(tmp_path, "prompts_other.csv", "x,y\n1,2\n")
    got = tables.load_prompt_sets(spark, [good, empty, other, str(tmp_path / "none.csv")])
    assert got.count() == 1


def test_labelled_files(spark, tmp_path):
    a = put(tmp_path, "run1/processed/responses_labeled_a.csv",
            f'{HEADER}\nt,1,q1,"x, y",g,TRUE\n,2,q2,NA,g,False\nt,3,q3,,g,1\n')
    b = put(tmp_path, "run+2 %/processed/b_labeled.csv", f"{HEADER},reasoning\nt,1,q,r,g,no,exact_match\n")
    long = put(tmp_path, "run2/processed/long.csv", f"{HEADER}\nt,1,q,r,g,yes,extra\n")
    lacking = put(tmp_path, "run2/processed/lacking.csv", "prompt,id\nq,1\n")
    paths = [a, b, long, lacking, str(tmp_path / "none.csv")]
    rows = tables.read_labeled(spark, paths).orderBy("source", "id").collect()
    assert [(r["run"], r["source"], r["template"], r["model_response"], r["hallucinated"]) for r in rows] == [
        ("run+2 %", "b", "t", "r", "no"),
        ("run1", "responses_labeled_a.csv", "t", "x, y", "TRUE"),
        ("run1", "responses_labeled_a.csv", None, None, "False"),
        ("run1", "responses_labeled_a.csv", "t", None, "1"),
    ]
    with pytest.raises(ValueError, match="missing required"):
        tables.read_labeled(spark, [lacking], on_problem="fail")
    with pytest.raises(ValueError, match="malformed"):
        tables.read_labeled(spark, [long], on_problem="fail")
    with pytest.raises(FileNotFoundError):
        tables.read_labeled(spark, paths[-1:], on_problem="fail")


def test_discover_is_recursive_and_by_name(spark, tmp_path):
    for name in ("a/responses_labeled_1.csv", "b/c/responses_labeled_2.csv", "b/hard_responses_labeled3.csv"):
        put(tmp_path, name, "x\n1\n")
    found = [os.path.basename(r.path) for r in tables.discover(spark, str(tmp_path)).collect()]
    assert found == ["responses_labeled_1.csv", "responses_labeled_2.csv"]


def test_labelled_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r1", "prompts_a.csv", "t", 1, 'say "hi",\nthen', " Paris", "Paris"), ("r1", "prompts_a.csv", "t", 2, "q", "", "x")],
        "run string, source string, template string, id int, prompt string, model_response string, correct_answer string",
    )
    labelled = jobs.label_answers(rows, keep=["run", "source"])
    out = str(tmp_path / "labels")
    tables.write_labeled(labelled, out)
    folder = os.path.join(out, "run=r1", "source=responses_labeled_a.csv")
    parts = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".csv")]
    back = tables.read_labeled(spark, parts, missing_words=False).orderBy("id").collect()
    assert [(r["prompt"], r["model_response"], r["hallucinated"], r["reasoning"]) for r in back] == [
        ('say "hi",\nthen', " Paris", "false", "exact_match"), ("q", "", "false", "empty_response")
    ]
    with pytest.raises(AnalysisException):
        tables.write_labeled(labelled, out)


def test_prompts_are_quoted_and_never_empty(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, 'a "b"', "c")], "template string, id int, prompt string, correct_answer string")
    out = str(tmp_path / "prompts")
    with pytest.raises(ValueError):
        tables.write_prompts(df.limit(0), out)
    for _ in range(2):
        tables.write_prompts(df, out)
    lines = set()
    for name in os.listdir(out):
        if name.endswith(".csv"):
            with open(os.path.join(out, name), encoding="utf-8") as f:
                lines.update(f.read().splitlines())
    assert lines == {'"template","id","prompt","correct_answer"', '"t","1","a ""b""","c"'}


def test_audit_is_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("f", "", "")], "source_file string, human_hallucinated string, human_notes string")
    out = str(tmp_path / "audit")
    tables.write_audit(df, out)
    with pytest.raises(AnalysisException):
        tables.write_audit(df, out)


def test_report_and_metric_files(spark, tmp_path):
    rows = spark.range(200).select(
        F.lit("s1").alias("source"), "id", F.lit("t").alias("template"),
        F.expr("concat('capital number ', id % 3, ' of land')").alias("prompt"),
        F.lit("x").alias("model_response"), F.expr("if(id % 4 = 0, 'yes', 'no')").alias("hallucinated"),
    )
    parts = jobs.report(rows, replicates=200, top_keywords=2)
    assert parts["template"].first()["hallucination_rate"] == 0.25
    assert {r["keyword"] for r in parts["keywords"].collect()} <= {"capital", "number", "land", "of"}
    out = str(tmp_path / "metrics")
    tables.write_metrics(parts["metrics"], out)
    folder = os.path.join(out, "source=s1")
    name = next(f for f in os.listdir(folder) if f.endswith(".json"))
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        record = json.loads(f.read())
    assert record["hallucination_rate"] == 0.25 and record["n"] == 200 and record["hallucinations"] == 50
    low, high = record["hallucination_rate_ci95"]
    assert low < 0.25 < high
    tables.write_processed(parts["processed"], str(tmp_path / "processed"))
    header = spark.read.csv(str(tmp_path / "processed"), header=True).columns
    assert header == ["prompt", "model_response", "is_correct", "hallucinated"]
