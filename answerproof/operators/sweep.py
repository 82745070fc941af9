"""What rates would be under other thresholds: a whole grid of them out of one scan.

A row's answer to "contradiction?" or "similar?" changes once at most as a threshold rises, at the row's own
score. So a row is one event, the number of grid values up to which it counts; events are summed by
group and grid place, and running totals over the few places give the count at every value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.functions.bind import bound
from answerproof.operators import decide, scores
from answerproof.operators.signals import w

# Thresholds that can be swept, and whether rows count from a value on (instead of up to it).
SWEPT = {
    "nli_contradiction_veto": False,
    "nli_entailment_veto_floor": True,
    "embed_min_similarity": False,
    "jaccard_min": False,
}


def _places(score: Column, grid: Sequence[float], rising: bool) -> Column:
    """How many grid values, in the order they are walked, a row with this score counts at."""
    values = F.array(*[F.lit(g) for g in grid])
    keep = (lambda v, s: v >= s) if rising else (lambda v, s: v <= s)
    return bound({"s": score}, lambda b: F.size(F.filter(values, lambda v: keep(v, b["s"]))))


def _events(th: Thresholds, grids: dict[str, list[float]]) -> list[Column]:
    """One struct (threshold, measure, places) for each measure that depends on a threshold."""
    always = {name: F.lit(len(grid)) for name, grid in grids.items()}
    never = F.lit(0)
    answered, embed = w("resp") != "", w("embed")
    entail, contra = w("nli_entail_min"), w("nli_contradiction_max")
    by_rule = ~scores.undecided_by_rules()
    vetoed = scores.nli_veto(entail, contra, th)
    plain = ~(w("exact") | w("numeric_match") | w("substring") | w("subsequence"))
    gate_open = scores.embedding_gate(embed, th).isNull()

    def places(name: str, score: Column) -> Column:
        return _places(score, grids[name], SWEPT[name])

    out = {}
    if "nli_contradiction_veto" in grids:
        out["nli_contradiction_veto", "hallucinated"] = (
            F.when(by_rule, always["nli_contradiction_veto"])
            .when(entail <= th.nli_entailment_veto_floor, places("nli_contradiction_veto", contra))
            .otherwise(never)
        )
    if "nli_entailment_veto_floor" in grids:
        out["nli_entailment_veto_floor", "hallucinated"] = (
            F.when(by_rule, always["nli_entailment_veto_floor"])
            .when(contra >= th.nli_contradiction_veto, places("nli_entailment_veto_floor", entail))
            .otherwise(never)
        )
    if "embed_min_similarity" in grids:
        similar = F.when(w("jaccard") >= th.jaccard_min, always["embed_min_similarity"]).otherwise(never)
        by_score = places("embed_min_similarity", embed)
        out["embed_min_similarity", "baseline_embed"] = (
            F.when(~answered, never).when(embed.isNotNull(), by_score).otherwise(similar)
        )
        accepted = ~(by_rule | vetoed)
        out["embed_min_similarity", "embedding_support"] = F.when(
            accepted & plain & embed.isNotNull() & gate_open, by_score
        ).otherwise(never)
    if "jaccard_min" in grids:
        similar = F.when(embed >= th.embed_min_similarity, always["jaccard_min"]).otherwise(never)
        out["jaccard_min", "baseline_embed"] = (
            F.when(~answered, never)
            .when(embed.isNull(), places("jaccard_min", w("jaccard")))
            .otherwise(similar)
        )
    return [
        F.struct(F.lit(name).alias("threshold"), F.lit(measure).alias("measure"), count.cast("int").alias("__places"))
        for (name, measure), count in out.items()
    ]


def threshold_sweep(
    df: DataFrame,
    grids: dict[str, Sequence[float]],
    by: Sequence[str] = (),
    th: Thresholds = Thresholds(),
    response: str = "model_response",
    gold: str = "correct_answer",
) -> DataFrame:
    """Counts and rates per group, threshold and grid value: ``threshold, value, measure, n, positives, rate``.

    Each threshold is varied alone, the others as in ``th``. Measures are ``hallucinated`` for the two
    entailment thresholds, ``baseline_embed`` for the two similarity ones, and ``embedding_support``
    (accepted for that reason) for the embedding one. Score columns are used as ``label_pairs`` uses
    them. One scan; the shuffle carries a row for each group and grid place of a task.
    """
    unknown = set(grids) - set(SWEPT)
    if unknown:
        raise ValueError(f"thresholds that cannot be swept: {sorted(unknown)}")
    walked = {name: sorted(set(map(float, g)), reverse=SWEPT[name]) for name, g in grids.items() if len(g)}
    if not walked:
        raise ValueError("no grid")
    signals = decide.with_signals(df, th, response, gold)
    events = signals.select(*by, F.inline_outer(F.array(*_events(th, walked))))
    summed = events.groupBy(*by, "threshold", "measure", "__places").agg(F.count(F.lit(1)).alias("__n"))
    # places run from 0 to the length of a grid: these totals are over that many rows
    group = [*by, "threshold", "measure"]
    whole = summed.groupBy(*group).agg(
        F.sum("__n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__places", "__n"))).alias("__at")
    )
    values = F.create_map(*[x for name, g in walked.items() for x in (F.lit(name), F.array(*map(F.lit, g)))])
    each = whole.select(*group, "n", "__at", F.posexplode(values[F.col("threshold")]).alias("__place", "value"))
    counted = F.aggregate(
        F.map_entries("__at"), F.lit(0).cast("bigint"),
        lambda total, e: total + F.when(e["key"] > F.col("__place"), e["value"]).otherwise(0),
    )
    return each.select(
        *by, "threshold", "value", "measure", "n", counted.alias("positives"), (counted / F.col("n")).alias("rate")
    )
