"""Model scores that are kept: every pair of texts is scored once in its life, in both directions.

The store is a table in a shared folder, partitioned by the first digits of a pair's digest. A job looks
for the distinct pairs that need a score, drops those the store has, runs the caller's scorer over the
rest and appends the result. Labels then join what is stored. Copies of a pair collapse before any
shuffle, and a hot pair is split by adaptive skew joins, as the store side has one row per pair.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.operators import scores
from answerproof.operators.signals import add_canonical, add_signals, drop_working, w
from answerproof.session import written

# First digits of a digest that name a folder of the store: 256 folders.
PART_DIGITS = 2
KEY = ("part", "digest")
PROBABILITIES = ("entailment", "neutral", "contradiction")
SCORER_OUTPUT = "part string, digest string, dir string, entailment double, neutral double, contradiction double"
STORED = (
    "part string, digest string, nli_fwd struct<entailment: double, neutral: double, contradiction: double>, "
    "nli_rev struct<entailment: double, neutral: double, contradiction: double>"
)

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def pair_digest(response: Column, gold: Column) -> Column:
    """128-bit name of an ordered pair of texts; the length in front keeps the border between them."""
    return F.md5(F.concat_ws(":", F.length(response).cast("string"), F.concat(response, gold)))


def _keyed(df: DataFrame) -> DataFrame:
    digest = pair_digest(w("resp"), w("gold"))
    return df.withColumn("digest", digest).withColumn("part", F.substring("digest", 1, PART_DIGITS))


def pairs_to_score(
    df: DataFrame, th: Thresholds = Thresholds(), response: str = "model_response",
    gold: str = "correct_answer", for_reason: bool = True,
) -> DataFrame:
    """Distinct canonical pairs (part, digest, response, gold) whose decision depends on a score.

    Both sides have three tokens or more, and no rule ahead of the score has decided. With
    ``for_reason=False`` only the yes or no counts, so pairs that any rule decides are left out.
    """
    df = add_signals(df.select(response, gold), th, response, gold)
    open_ = scores.undecided_before_nli() if for_reason else scores.undecided_by_rules()
    needed = df.filter(scores.nli_eligible(th) & open_)
    return _keyed(needed).select(*KEY, w("resp").alias("response"), w("gold").alias("gold")).distinct()


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored pair: part, digest, and the probabilities of both directions.

    A pair that stands twice, as two jobs scored it at the same time, is one row; one that lacks a
    direction, as a job was lost while it appended, does not count as stored.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(SCORER_OUTPUT).parquet(path)
    found = F.struct(*PROBABILITIES)
    both = rows.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("dir") == d, found)).alias(f"nli_{d}") for d in scores.NLI_DIRECTIONS]
    )
    return both.filter(F.col("nli_fwd").isNotNull() & F.col("nli_rev").isNotNull())


def missing_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs that the store does not have."""
    return pairs.join(stored_scores(pairs.sparkSession, path).select(*KEY), list(KEY), "left_anti")


def score_missing(pairs: DataFrame, path: str, make_scorer: Callable[[], Scorer]) -> int:
    """Score the pairs the store lacks and append them; the number of pairs scored.

    ``make_scorer`` builds the model once per Python worker task. The function it returns gets frames
    with a ``premise`` and a ``hypothesis`` and returns the frame with the three probabilities added;
    each pair is scored from response to gold ("fwd") and from gold to response ("rev"). Running this
    again scores nothing: what is left to do is written before the scorer runs and is read from there,
    and the result is appended by one commit.
    """
    todo = written(missing_pairs(pairs, path), "unscored")
    count = todo.count()
    if not count:
        return 0
    directions = F.array(
        F.struct(F.lit("fwd").alias("dir"), F.col("response").alias("premise"), F.col("gold").alias("hypothesis")),
        F.struct(F.lit("rev").alias("dir"), F.col("gold").alias("premise"), F.col("response").alias("hypothesis")),
    )
    # small texts cost a model far more than their bytes tell, so they are spread by number
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    asked = todo.repartition(cores, "digest").select(*KEY, F.inline(directions))
    names = [*KEY, "dir", *PROBABILITIES]

    def make() -> Scorer:
        scorer = make_scorer()
        return lambda batch: scorer(batch)[names]

    scored = scores.run_scorer(asked, make, SCORER_OUTPUT)
    # files of even size, of one folder each
    scored.hint("rebalance", "part").write.partitionBy("part").parquet(path, mode="append")
    return count


def attach_stored(
    df: DataFrame, path: str, th: Thresholds = Thresholds(), response: str = "model_response",
    gold: str = "correct_answer",
) -> DataFrame:
    """The table with what the store has on its pairs: ``nli_fwd`` and ``nli_rev`` (probabilities of
    each direction), ``nli_entail_min`` and ``nli_contradiction_max``; all NULL for other pairs."""
    keyed = _keyed(add_canonical(df, response, gold)).withColumnsRenamed({k: f"__{k}" for k in KEY})
    stored = stored_scores(df.sparkSession, path).withColumnsRenamed({k: f"__s_{k}" for k in KEY})
    same = [F.col(f"__{k}") == F.col(f"__s_{k}") for k in KEY]
    found = keyed.join(stored, same, "left")
    both = {
        "nli_entail_min": F.least("nli_fwd.entailment", "nli_rev.entailment"),
        "nli_contradiction_max": F.greatest("nli_fwd.contradiction", "nli_rev.contradiction"),
    }
    return drop_working(found.withColumns(both))
