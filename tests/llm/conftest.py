import pytest
from pyspark.sql import types as T

#: Missing values, empty and long texts, ties, repeated rows, and columns with clashing names.
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def _rows():
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    near = base.replace("alpha30", "gamma30")
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", "b"),
        (3, near, "en", "b"),  # a repeated row
        (4, None, None, None),
        (4, None, "en", None),
        (5, "", "en", "b"),
        (6, "", "de", ""),
        (7, " \t\n ", None, "c"),
        (None, "one two three four", "en", "c"),
        (None, base + " tail", "en", "a"),
        (8, LONG, "en", "a"),
        (9, f"intro of nine\n{PASSAGE}\nend of nine", "de", "a"),
        (10, f"other words of ten\n{PASSAGE}\nlast words of ten", "de", "a"),
        (11, "ünïcode ſtraße 日本語 текст\x00 \U0001f600", "de", "b"),
    ]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        *[
            T.StructField(n, T.LongType())
            for n in ("n_chars", "n", "d", "k", "tid", "label", "slot", "position", "removed", "toxicity", "rank")
        ],
    ]
)


@pytest.fixture(scope="session")
def odd(spark):
    rows = [r + (len(r[1]) if r[1] is not None else None,) + (7,) * 10 for r in _rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 3 % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
