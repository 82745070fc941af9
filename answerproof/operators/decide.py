"""The decision: does a response contradict its reference answer, and which rule says so.

Rules are tried in a fixed order and the first hit names the reason. A response counts as
contradicting only on positive evidence; everything else is accepted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.functions import cues
from answerproof.functions.text import strip, text_or_empty
from answerproof.operators import scores
from answerproof.operators.signals import (
    add_canonical,
    add_signals,
    drop_working,
    numeric_diagnostics,
    w,
)

EMBED_SCORE = "embed_score"
NLI_ENTAIL_MIN = "nli_entail_min"
NLI_CONTRADICTION_MAX = "nli_contradiction_max"

# Reasons for a contradiction, in decision order.
CONTRADICTION_REASONS = (
    "empty_response",
    "contradiction_cue",
    "nli_contradiction_veto",
    "numeric_alternative_conflict",
    "numeric_conflict",
    "unavailability_claim_conflicts_with_gold",
    "atomic_entity_mismatch",
)
# Reasons for accepting, in order.
ACCEPTING_REASONS = (
    "exact_match",
    "numeric_match",
    "substring_match",
    "token_subsequence_match",
    "embedding_support",
    "no_contradiction_evidence",
)


# Columns that labelling adds, and those it adds with diagnostics.
DECIDED = (
    "hallucinated", "accepted", "reason", "baseline_exact", "baseline_embed", "baseline_embed_score",
    "baseline_embed_method",
)
DIAGNOSED = (
    "normalized_substring", "token_subsequence", "jaccard", "numeric_match", "numeric",
    "numeric_conflict_if_present", "numeric_alternative_conflict", "embedding_gate", "embedding_match",
    "nli_entail_min", "nli_contradiction_max", "nli_contradiction_veto", "contradiction_heuristic",
    "unavailability_claim", "weak_passes", "weak_required", "normalized_response",
    "normalized_correct_answer",
)


def _first_reason(names: tuple[str, ...], hits: list[Column]) -> Column:
    chain = F.when(hits[0], names[0])
    for name, hit in zip(names[1:], hits[1:]):
        chain = chain.when(hit, name)
    return chain


def _score_column(df: DataFrame, name: str, enabled: bool, what: str, th: Thresholds) -> Column:
    if enabled and name in df.columns:
        return F.col(name).cast("double")
    if enabled and th.strict_dependencies:
        raise ValueError(
            f"{what} scores are enabled but the table has no {name!r} column; attach scores, "
            "disable them in Thresholds, or set strict_dependencies=False"
        )
    return F.lit(None).cast("double")


def _lacking(th: Thresholds, undecided: Column) -> dict[str, Column]:
    """Rows without a score they need, by kind of score."""
    needs = {}
    if th.enable_embeddings:
        needs["embedding"] = (w("resp") != "") & w("embed").isNull()
    if th.enable_nli:
        absent = w("nli_entail_min").isNull() | w("nli_contradiction_max").isNull()
        needs["entailment"] = undecided & scores.nli_eligible(th) & absent
    return needs


def _with_scores(df: DataFrame, th: Thresholds, undecided: Column) -> DataFrame:
    """Score columns, NULL where they are not used. ``undecided``: rows that need an entailment score
    if their texts are long enough for one."""
    embed = _score_column(df, EMBED_SCORE, th.enable_embeddings, "embedding", th)
    entail = _score_column(df, NLI_ENTAIL_MIN, th.enable_nli, "entailment", th)
    contra = _score_column(df, NLI_CONTRADICTION_MAX, th.enable_nli, "entailment", th)
    if th.enable_nli:
        eligible = (w("resp") != "") & scores.nli_eligible(th)
        entail, contra = F.when(eligible, entail), F.when(eligible, contra)
    df = df.withColumns(
        {"__embed": embed, "__nli_entail_min": entail, "__nli_contradiction_max": contra}
    )
    return scores.all_scored(df, _lacking(th, undecided)) if th.strict_dependencies else df


def preflight(
    df: DataFrame,
    th: Thresholds = Thresholds(),
    response: str = "model_response",
    gold: str = "correct_answer",
) -> None:
    """Count rows that need a score and lack it, and raise if there are any.

    Tells before a long job starts what the strict policy would stumble over in the middle of it.
    """
    lenient = replace(th, strict_dependencies=False)
    undecided = scores.undecided_before_nli()
    signals = add_canonical(df, response, gold).withColumn("__negated", cues.negation_cue(w("resp"), w("gold")))
    needs = _lacking(th, undecided)
    if not needs:
        return
    df = _with_scores(signals, lenient, undecided)
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in needs.items()]).first()
    missing = {name: n for name, n in counts.asDict().items() if n}
    if missing:
        raise RuntimeError(f"rows without a score they need: {missing}")


def with_signals(
    df: DataFrame, th: Thresholds, response: str, gold: str, for_reason: bool = True
) -> DataFrame:
    """All signals and the scores in use, as working columns."""
    undecided = scores.undecided_before_nli() if for_reason else scores.undecided_by_rules()
    return _with_scores(add_signals(df, th, response, gold), th, undecided)


def _decided(
    df: DataFrame, th: Thresholds, response: str, gold: str, for_reason: bool = True
) -> DataFrame:
    df = with_signals(df, th, response, gold, for_reason)
    contradiction = _first_reason(
        CONTRADICTION_REASONS,
        [
            w("resp") == "",
            w("negated"),
            scores.nli_veto(w("nli_entail_min"), w("nli_contradiction_max"), th),
            w("alternative_conflict"),
            w("numeric_conflict"),
            w("unavailability_conflict"),
            w("atomic_mismatch"),
        ],
    )
    return df.withColumn("__contradiction", contradiction)


def label_pairs(
    df: DataFrame,
    th: Thresholds = Thresholds(),
    response: str = "model_response",
    gold: str = "correct_answer",
    diagnostics: bool = False,
    where: Sequence[str] = (),
) -> DataFrame:
    """Add the decision, its reason and the baseline columns to a table of pairs.

    Optional score columns are picked up by name: ``embed_score``, ``nli_entail_min`` and
    ``nli_contradiction_max``. With ``diagnostics`` every signal is added too, always with the same
    schema; signals are NULL for an empty response. ``where``: conditions on the result; those on columns
    of the table alone are applied to it before anything is computed, so they reach its scan.
    """
    before, after = split_conditions(where, DECIDED if not diagnostics else DECIDED + DIAGNOSED)
    df = _decided(_filtered(df, before), th, response, gold)
    answered = w("resp") != ""
    accepting = _first_reason(
        ACCEPTING_REASONS,
        [
            w("exact"),
            w("numeric_match"),
            w("substring"),
            w("subsequence"),
            scores.embedding_support(w("embed"), th),
            F.lit(True),
        ],
    )
    similar = scores.baseline_similar(w("embed"), w("jaccard"), th)
    added = {
        "hallucinated": w("contradiction").isNotNull(),
        "accepted": w("contradiction").isNull(),
        "reason": F.coalesce(w("contradiction"), accepting),
        "baseline_exact": answered & w("exact"),
        "baseline_embed": answered & similar,
        "baseline_embed_score": F.when(answered, F.coalesce(w("embed"), w("jaccard"))),
        "baseline_embed_method": F.when(answered, scores.baseline_method(w("embed"))).otherwise(
            "none"
        ),
    }
    if diagnostics:
        weak = (
            w("subsequence").cast("int")
            + (w("jaccard") >= th.jaccard_min).cast("int")
            + similar.cast("int")
        )
        plain = {
            "normalized_substring": w("substring"),
            "token_subsequence": w("subsequence"),
            "jaccard": w("jaccard"),
            "numeric_match": w("numeric_match"),
            **numeric_diagnostics(th),
            "embedding_gate": scores.embedding_gate(w("embed"), th),
            "embedding_match": scores.embedding_support(w("embed"), th),
            "nli_entail_min": w("nli_entail_min"),
            "nli_contradiction_max": w("nli_contradiction_max"),
            "nli_contradiction_veto": scores.nli_veto(
                w("nli_entail_min"), w("nli_contradiction_max"), th
            ),
            "contradiction_heuristic": w("negated"),
            "unavailability_claim": w("unavailable"),
            "weak_passes": F.when(w("contradiction").isNull(), weak),
            "weak_required": F.when(w("contradiction").isNull(), F.lit(th.weak_signals_required)),
        }
        added |= {name: F.when(answered, c) for name, c in plain.items()}
        added |= {"normalized_response": w("resp"), "normalized_correct_answer": w("gold")}
    return _filtered(_observed(drop_working(df.withColumns(added))), after)


def flag_pairs(
    df: DataFrame,
    th: Thresholds = Thresholds(),
    response: str = "model_response",
    gold: str = "correct_answer",
    where: Sequence[str] = (),
) -> DataFrame:
    """Only the yes/no decision; signals that merely explain an acceptance are pruned away.

    With the strict policy an entailment score is needed only where no rule decides. ``where`` as in
    ``label_pairs``.
    """
    before, after = split_conditions(where, DECIDED[:1])
    df = _decided(_filtered(df, before), th, response, gold, for_reason=False)
    flagged = df.withColumn("hallucinated", w("contradiction").isNotNull())
    return _filtered(_observed(drop_working(flagged)), after)


def split_conditions(where: Sequence[str], added: Sequence[str]) -> tuple[list[str], list[str]]:
    """Conditions on a table's own columns, and those that name a column that is added to it.

    Labelling cannot be left to the optimiser for this: the fence above it and Unicode normalisation
    below keep a filter on the result where it is.
    """
    late = {c.lower() for c in added}
    before, after = [], []
    for condition in where:
        bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", " ", condition)
        names = {n.lower() for n in re.findall(r"[A-Za-z_]\w*", bare)}
        (after if names & late else before).append(condition)
    return before, after


def _filtered(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    for condition in conditions:
        df = df.filter(condition)
    return df


def _observed(df: DataFrame) -> DataFrame:
    """Report the number of labelled rows as an observed metric.

    It is also a fence: without it a filter on the label would be pushed below the layers of
    signals, and inlining them there repeats every shared expression many times over.
    """
    return df.observe(f"labelled_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def abstention_rule(response: Column | str, hallucinated: Column | str) -> Column:
    """A blank answer is an abstention, never a contradiction, whatever the detector said."""
    flag = F.col(hallucinated) if isinstance(hallucinated, str) else hallucinated
    return F.when(strip(text_or_empty(response)) == "", F.lit(False)).otherwise(flag)
