"""Model scores: attach stored scores, compute cosines, or run a caller's scorer once per pair.

No model ships with this package. Scores come from tables, or from a scorer the caller passes.
All joins leave the choice of strategy to the planner: score tables grow with the data, so nothing
is broadcast by hand, and a hot pair is split by adaptive skew-join handling because the score side
holds one row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.functions import text
from answerproof.functions.flags import cosine
from answerproof.operators.signals import w
from answerproof.operators.small import is_empty

NLI_DIRECTIONS = ("fwd", "rev")


def distinct_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key combination once. Copies collapse before the shuffle, so a hot pair costs one row."""
    return df.select(*keys).distinct()


def score_distinct(
    df: DataFrame, keys: Sequence[str], score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Score every distinct key combination once and join the scores back to all rows.

    ``score`` maps a table of distinct keys to the same table with score columns added.
    """
    scored = score(distinct_pairs(df, keys)).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(scored, condition, "left").drop(*[f"__k_{k}" for k in keys])


def pair_cosine(
    pairs: DataFrame,
    vectors: DataFrame,
    resp_key: str,
    gold_key: str,
    vec_key: str = "vec_id",
    vec: str = "embedding",
    out: str = "embed_score",
) -> DataFrame:
    """Cosine of the response vector and the gold vector of each row.

    Vectors are joined to distinct key pairs only; the rows themselves never carry a vector. A key that
    stands twice among the vectors would multiply rows and is refused; keys are checked when this is
    called.
    """
    repeated = vectors.groupBy(vec_key).count().filter("count > 1")
    if not is_empty(repeated):
        named = sorted(str(r[0]) for r in repeated.limit(5).collect())
        raise ValueError(f"vectors repeat keys, for example {named}")

    def score(keys: DataFrame) -> DataFrame:
        left = vectors.select(F.col(vec_key).alias(resp_key), F.col(vec).alias("__u"))
        right = vectors.select(F.col(vec_key).alias(gold_key), F.col(vec).alias("__v"))
        both = keys.join(left, resp_key, "left").join(right, gold_key, "left")
        known = F.col("__u").isNotNull() & F.col("__v").isNotNull()
        return both.select(
            resp_key, gold_key, F.when(known, cosine("__u", "__v")).alias(out)
        )

    return score_distinct(pairs, [resp_key, gold_key], score)


def nli_summary(scores: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Least entailment and greatest contradiction over the two directions of each pair."""
    return scores.groupBy(*keys).agg(
        F.min("entailment").alias("nli_entail_min"),
        F.max("contradiction").alias("nli_contradiction_max"),
    )


def attach_nli(pairs: DataFrame, scores: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return pairs.join(nli_summary(scores, keys), list(keys), "left")


def nli_eligible(th: Thresholds) -> Column:
    """Both sides have enough tokens for an entailment model (needs add_canonical)."""
    return (text.token_count(w("resp")) >= th.nli_min_tokens) & (
        text.token_count(w("gold")) >= th.nli_min_tokens
    )


def undecided_before_nli() -> Column:
    """No rule that is tried ahead of the entailment veto has decided (needs the signals)."""
    return (w("resp") != "") & ~w("negated")


def undecided_by_rules() -> Column:
    """No deterministic rule has decided, so the veto alone can make it a contradiction."""
    return undecided_before_nli() & ~(
        w("alternative_conflict") | w("numeric_conflict") | w("unavailability_conflict") | w("atomic_mismatch")
    )


def nli_veto(entail_min: Column, contradiction_max: Column, th: Thresholds) -> Column:
    return F.coalesce(
        (contradiction_max >= th.nli_contradiction_veto)
        & (entail_min <= th.nli_entailment_veto_floor),
        F.lit(False),
    )


def baseline_method(score: Column) -> Column:
    return F.when(score.isNotNull(), "embedding").otherwise("jaccard")


def baseline_similar(score: Column, jaccard: Column, th: Thresholds) -> Column:
    return F.when(score.isNotNull(), score >= th.embed_min_similarity).otherwise(
        jaccard >= th.jaccard_min
    )


def embedding_gate(score: Column, th: Thresholds) -> Column:
    """Name of the gate that keeps the embedding from counting as support; NULL if none does."""
    gate = F.when(
        text.token_count(w("gold")) <= th.embed_disable_for_very_short_gold_tokens, "gold_too_short"
    )
    if th.embed_require_shared_content_tokens:
        shared = text.shared_content_count(w("resp"), w("gold"))
        gate = gate.when(
            shared < th.embed_min_shared_content_tokens, "insufficient_shared_content"
        )
    return F.when(score.isNotNull(), gate)


def embedding_support(score: Column, th: Thresholds) -> Column:
    """High similarity that no gate blocks."""
    return F.coalesce(
        (score >= th.embed_min_similarity) & embedding_gate(score, th).isNull(), F.lit(False)
    )


def all_scored(df: DataFrame, needs: dict[str, Column]) -> DataFrame:
    """Strict policy: a row that needs a score and has none fails the job.

    ``needs`` has for each kind of score the rows that lack one. It is a filter that lets every row
    pass, not a part of the score, so it holds whatever columns are selected later.
    """
    for what, lacking in needs.items():
        message = F.lit(f"{what} score missing; supply it, disable {what} or use the lenient policy")
        df = df.filter(F.when(lacking, F.raise_error(message).cast("boolean")).otherwise(True))
    return df


def missing_scores(pairs: DataFrame, scored: Column, needed: Column, *by: str) -> DataFrame:
    """How many rows need a score and how many of them lack it."""
    return pairs.groupBy(*by).agg(
        F.count_if(needed).alias("eligible"),
        F.count_if(needed & scored.isNull()).alias("missing"),
    )


def run_scorer(
    pairs: DataFrame,
    make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run a caller's batch scorer over a table of distinct pairs.

    ``make_scorer`` builds the model; it is called once per Python worker task, then the returned
    function sees Arrow batches as pandas frames and must return frames of ``schema``. Pass a nested
    function, or ship its module to the workers.
    """

    def score_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield scorer(batch)

    return pairs.mapInPandas(score_partition, schema)
