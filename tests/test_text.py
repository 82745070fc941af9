"""Canonical text and overlap against plain Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from answerproof.config import ANSWER_STOPWORDS, RULES_ONLY
from answerproof.functions import text


def plain_canonical(s: str) -> str:
    """Character by character: what survives normalisation, and a blank for what does not."""
    composed = "".join({"×": "x", "−": "-", "–": "-", "—": "-"}.get(c, c) for c in unicodedata.normalize("NFKC", s))
    kept = []
    for c in unicodedata.normalize("NFKD", composed.lower()):
        if unicodedata.combining(c):
            continue
        kept.append(c if c.isalnum() or c in "_-./^+:=" else " ")
    return " ".join("".join(kept).split())


def is_float(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


ALPHABET = (
    list("abcxyzABCXYZ0123456789") + list(" \t\n-./^+:=_,;!?()[]{}'\"*&%$#@<>|~`\\")
    + list("éÉßñüçœøŁİıΣσςдЖאبक।你好ﬁ½²³⁻⁰①Ⅷ°ºª×−–—’“”…Ａｂ３̧́िิ‍  ẛͅ")
)


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 40))) for _ in range(n)]


def column_of(spark, values, c):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i int, v string").select("i", c(F.col("v")).alias("out"))
    return [r["out"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_canonical_matches_plain_python(spark):
    texts = random_texts(3000, 1) + ["", "   ", "Paris", "À la recherche du temps perdu", "x" * 5000]
    assert column_of(spark, texts, text.canonical) == [plain_canonical(t) for t in texts]


def test_canonical_is_idempotent_on_ascii(spark):
    texts = [t for t in random_texts(2000, 2) if t.isascii()] + ["It's  A TEST!", "10^-21 = 1e-21"]
    once = column_of(spark, texts, text.canonical)
    assert column_of(spark, once, text.canonical) == once


def test_null_reads_as_empty(spark):
    assert column_of(spark, [None], text.canonical) == [""]


def test_strip_removes_every_blank(spark):
    texts = ["  a b \x1c", "\x85x　", "", " \t\r\n"]
    assert column_of(spark, texts, text.strip) == [t.strip() for t in texts]


def test_tokens_and_their_count(spark):
    cans = [plain_canonical(t) for t in random_texts(500, 3)]
    assert column_of(spark, cans, text.tokens) == [c.split() for c in cans]
    assert column_of(spark, cans, text.token_count) == [len(c.split()) for c in cans]


def test_content_tokens(spark):
    odd = "nan inf infinity 1_0 1__0 _1 1_ 1e5 1e 1d 1f +5 .5 5. . - -inf +nan 1.5e-3 ٣ x xy the theta why"
    cans = [plain_canonical(t) for t in random_texts(500, 4)] + [odd, ""]
    want = [
        [t for t in c.split() if len(t) > 1 and t not in ANSWER_STOPWORDS and not is_float(t)]
        for c in cans
    ]
    assert column_of(spark, cans, text.content_tokens) == want


def subsequence(resp, gold):
    rest = iter(resp)
    return bool(gold) and all(t in rest for t in gold)


def test_overlap_of_random_pairs(spark):
    rng = random.Random(5)
    words = ["red", "green", "blue", "two", "2", "a"]
    pairs = [
        (" ".join(rng.choices(words, k=rng.randrange(0, 7))), " ".join(rng.choices(words, k=rng.randrange(0, 4))))
        for _ in range(800)
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.withColumns({"ta": text.tokens("a"), "tb": text.tokens("b")})
    rows = df.select(
        "i",
        text.jaccard("ta", "tb").alias("j"),
        text.jaccard("tb", "ta").alias("k"),
        text.token_subsequence("a", "b", "ta", "tb", RULES_ONLY).alias("s"),
        text.contains_canonical("a", "b").alias("c"),
        text.shared_content_count("a", "b").alias("n"),
    ).collect()
    for r in rows:
        a, b = pairs[r["i"]]
        x, y = set(a.split()), set(b.split())
        want = 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0
        assert abs(r["j"] - want) < 1e-12 and r["j"] == r["k"] and 0 <= r["j"] <= 1
        assert r["s"] == (len(b) >= 4 and subsequence(a.split(), b.split()))
        assert r["c"] == (bool(a) and bool(b) and b in a)
        assert r["n"] == len((x & y) - {"2", "a"})
