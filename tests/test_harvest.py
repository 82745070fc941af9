"""Questions out of noisy generations."""

import json
import random
import re

import pytest

from answerproof.operators import harvest

CASES = [
    ('["a", "b"]', ["a", "b"]),
    ('```json\n["a", "b  c"]\n```', ["a", "b c"]),
    ('text ```JS\n["a"]``` and ```["b"]```', ["a"]),
    ('["a", 1, null, true, {"q": "x"}, ["y"], " ", "b"]', ["a", "b"]),
    ('Sure: ["a", "b"] done [1]', ["a", "b"]),
    ('Sure: ["a ] b"] done', ['Sure: ["a ] b"] done']),
    ('x [["a"], "b"] y', ["b"]),
    ("[]", []),
    ('{"a": ["b"]}', ["b"]),
    ("[1, 2]", []),
    ('["a",', ['["a",'.rstrip(",")]),
    ("1. First?\n2) Second?,\n\n[\n", ["First?", "Second?"]),
    ("1. First?\n[\n]\n", []),
    ("[Is it so?\n", ["[Is it so?"]),
    ("```\nWhy?\n```", ["Why?"]),
    ("```json", []),
    ('"just text"', ['"just text"']),
    ("", []),
    (None, []),
    ("a\x0cb c", ["a", "b", "c"]),
    ("12 monkeys\n12. monkeys", ["12 monkeys", "monkeys"]),
    ("{},\n(),", []),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: repr(c[0])[:30])
def test_questions(found, case):
    assert found[case[0]] == case[1]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "g string")
    return {r["g"]: r["q"] for r in df.select("g", harvest.questions("g").alias("q")).collect()}


def python_balanced(s):
    depth, start = 0, s.find("[")
    for i in range(max(start, 0), len(s)):
        depth += {"[": 1, "]": -1}.get(s[i], 0)
        if start >= 0 and depth == 0:
            return s[start : i + 1]
    return None


def test_balanced_arrays_of_random_brackets(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("[]ab\"", k=rng.randrange(0, 20))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", harvest.first_balanced_array(df["t"]).alias("b")).collect()
    assert all(r["b"] == python_balanced(texts[r["i"]]) for r in rows)


def test_json_strings_match_the_json_module(spark):
    values = [["a", 2, None], [], ["ü\n x", "\"q\""], {"a": 1}, "s", 3, [["a"]], [True, "t"]]
    texts = [json.dumps(v) for v in values] + ["nope", "['a']", '["a" "b"]', '["a\nb"]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", harvest.json_strings(df["t"]).alias("s")).collect():
        try:
            data = json.loads(r["t"])
        except ValueError:
            data = None
        want = [" ".join(x.split()) for x in data if isinstance(x, str) and x.strip()] if isinstance(data, list) else None
        assert r["s"] == want, r["t"]


def test_harvest_gives_one_row_per_question(spark):
    df = spark.createDataFrame([(1, '["a","b"]'), (2, "[]")], "id int, generation string")
    assert [tuple(r) for r in harvest.harvest_questions(df).orderBy("question_no").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_dedupe_keeps_the_first_and_stops_at_the_count(spark):
    asked = ["b", " a ", "b", "", "c", "a", "d"]
    df = spark.createDataFrame([("s", q, i) for i, q in enumerate(asked)] + [("t", "x", 0)], "seed string, question string, position int")
    got = harvest.dedupe_questions(df, 3).orderBy("seed", "question_no").collect()
    assert [(r["seed"], r["question"], r["position"], r["question_no"]) for r in got] == [
        ("s", "b", 0, 1), ("s", "a", 1, 2), ("s", "c", 4, 3), ("t", "x", 0, 1)
    ]
    assert [tuple(r) for r in harvest.incomplete_seeds(got_df(spark, got), 3).collect()] == [("t", 1, 3)]


def got_df(spark, rows):
    return spark.createDataFrame([(r["seed"], r["question"]) for r in rows], "seed string, question string")


def test_normalize_answer(spark):
    told = [" Paris. ", "New\t York ..\nbecause", "", None, "...", "A\x0bB"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", harvest.normalize_answer("t")).collect())]
    assert got == ["paris", "new york", "", "", "", "a"]


def test_majority_vote(spark):
    votes = {"q1": ["Paris.", "london", "paris"], "q2": ["b", "a"], "q3": ["", "x", " . "], "q4": ["", " "],
             "q5": ["z", "y", "y", "z"]}
    rows = [(q, a, i) for q, answers in votes.items() for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "question string, answer string, vote_no int")
    got = {r["question"]: (r["answer"], r["votes"], r["ballots"]) for r in harvest.majority_vote(df).collect()}
    assert got == {"q1": ("paris", 2, 3), "q2": ("b", 1, 2), "q3": ("x", 1, 1), "q5": ("z", 2, 4)}


def test_blank_answers(spark):
    df = spark.createDataFrame([("a",), (" ",), (None,)], "correct_answer string")
    assert harvest.blank_answers(df).count() == 2


def test_numbering_pattern_is_anchored():
    assert re.match(harvest.NUMBERING, "3) x") and not re.match(harvest.NUMBERING, "x 3) y")
