"""Number formats, comparison rules and coordinates, one row per behaviour."""

import math

import pytest
from pyspark.sql import functions as F

from answerproof.config import RULES_ONLY
from answerproof.functions import numeric, text
from answerproof.operators.signals import add_parsed_numbers, add_canonical, add_numeric, w


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    df = df.withColumn("can", text.canonical("v"))
    df = df.withColumn("t", numeric.number_text("v", "can"))
    df = df.withColumn("sci", numeric.scientific("t"))
    df = df.select(
        "i", "sci", numeric.numbers("t", "sci").alias("nums"),
        numeric.coordinate(numeric.ascii_digits(F.col("can"))).alias("coord"),
        numeric.looks_numeric(numeric.ascii_digits(F.col("can"))).alias("looks"),
    )
    return {texts[r["i"]]: r for r in df.collect()}


NUMBERS = {
    "1,000": [1.0, 0.0],
    "1.5kg": [1.0],
    "12kg": [],
    "343 m/s": [343.0],
    "-5 and +7": [-5.0, 7.0],
    "v2 3": [3.0],
    "3.14.15": [3.14, 15.0],
    "1e-21": [1e-21, 21.0],
    "2 e 3 units": [2000.0, 2.0, 3.0],
    "1.2x10^-3": [1.2e-3, 1.0, -3.0],
    "1.2 × 10^-3": [1.2e-3, 1.2, 10.0, -3.0],
    "1.2*10^-3": [1e-3, 1.2, 10.0, -3.0],
    "10^(-21)": [1e-21, 10.0, -21.0],
    "10⁻²¹": [1e-21, 10.0, -21.0],
    "10² in 1066": [1e2, 10.0, 2.0, 10.0, 66.0],
    "1e400": [],
    "10^400 x": [10.0, 400.0],
    "٣": [3.0],
    "": [],
    "none": [],
}


def test_numbers(spark):
    got = parsed(spark, list(NUMBERS))
    for t, want in NUMBERS.items():
        assert len(got[t]["nums"]) == len(want), (t, got[t]["nums"])
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[t]["nums"], want)), t


def test_scientific_out_of_range_is_no_value(spark):
    got = parsed(spark, ["1e400", "10^400 x", "1e-400"])
    assert got["1e400"]["sci"] is None and got["10^400 x"]["sci"] is None
    assert got["1e-400"]["sci"] == 0.0


COORDINATES = {
    "90 S": -90.0,
    "90° S": None,
    "12.5 degrees north": 12.5,
    "12.5 deg n": 12.5,
    "-30 west": -30.0,
    "-30 east": 30.0,
    "45°N": None,
    "1e-21": 1.0,
    "20 s": -20.0,
    "20 southern": None,
    "5 e": 5.0,
    "x5 n": None,
    "north 5": None,
}


def test_coordinates(spark):
    got = parsed(spark, list(COORDINATES))
    # the degree sign is dropped, so these two read like "90 s" and "45 n"
    want = COORDINATES | {"90° S": -90.0, "45°N": 45.0}
    assert {t: r["coord"] for t, r in got.items()} == want


LOOKS = {
    "1984": True, "1 e 5": True, "3/4": True, "(3 + 4)": True, "1.2x10^-3": False, "::1": False,
    "a=1": False, "343 m": False, "e": False, "": False, "2-3": True,
}


def test_looks_numeric(spark):
    got = parsed(spark, list(LOOKS))
    assert {t: r["looks"] for t, r in got.items()} == LOOKS


def python_same(x, g):
    def whole(v):
        return abs(v - round(v)) <= 1e-9

    if whole(x) and whole(g) and (abs(round(x)) >= 100 or abs(round(g)) >= 100):
        return round(x) == round(g)
    return math.isclose(x, g, rel_tol=5e-3, abs_tol=5e-2)


def test_same_number_on_a_grid(spark):
    values = [0.0, -0.0, 1e-21, 0.04, 0.05, 0.06, 1.0, 1.004, 1.006, 99.0, 99.4, 99.5, 100.0, 100.4,
              101.0, -100.0, -100.3, 1984.0, 1985.0, 1984.5, 1e15, 1e15 + 1, 2.5, 3.5]
    pairs = [(x, g) for x in values for g in values]
    df = spark.createDataFrame(pairs, "x double, g double")
    rows = df.select("x", "g", numeric.same_number(F.col("x"), F.col("g"), RULES_ONLY).alias("s")).collect()
    assert all(r["s"] == python_same(r["x"], r["g"]) for r in rows)


# response, gold → match, conflict, alternatives
RULES = [
    ("343 m/s", "343", (True, False, False)),
    ("342.9", "343", (True, False, False)),
    ("about 1985", "1984", (False, True, False)),
    ("1985, no, 1984", "1984", (False, False, False)),
    ("1984 then 1985", "1984", (True, False, False)),
    ("1984 or 1985", "1984", (True, False, True)),
    ("either 3 or 3.001", "3", (True, False, False)),
    ("3.01 or so", "3", (True, False, False)),
    ("in the nineties", "1990", (False, False, False)),
    ("90° S", "90 S", (True, True, False)),
    ("-90", "90 S", (True, False, False)),
    ("south", "90 S", (False, False, False)),
    ("-90 or -90.01", "90 S", (True, False, False)),
    ("10^-21", "1e-21", (False, True, False)),
    ("5 or 6", "five", (False, False, False)),
]


@pytest.mark.parametrize("case", RULES, ids=lambda c: f"{c[0]}|{c[1]}")
def test_rules(rules, case):
    response, gold, want = case
    assert rules[(response, gold)] == want


@pytest.fixture(scope="module")
def rules(spark):
    df = spark.createDataFrame([(r, g) for r, g, _ in RULES], "model_response string, correct_answer string")
    df = add_numeric(add_parsed_numbers(add_canonical(df)), RULES_ONLY)
    rows = df.select(
        "model_response", "correct_answer", w("numeric_match").alias("m"),
        w("numeric_conflict").alias("c"), w("alternative_conflict").alias("a"),
    ).collect()
    return {(r[0], r[1]): (r["m"], r["c"], r["a"]) for r in rows}
