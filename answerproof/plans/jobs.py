"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerproof.config import KEYWORD_STOPWORDS, RULES_ONLY, Thresholds
from answerproof.functions.text import strip
from answerproof.operators import audit, harvest, keywords, rates, resample
from answerproof.operators.decide import (
    EMBED_SCORE,
    NLI_CONTRADICTION_MAX,
    NLI_ENTAIL_MIN,
    abstention_rule,
    label_pairs,
)
from answerproof.operators.ranking import number_rows
from answerproof.operators.schema import (
    POSITION,
    add_features,
    attach_generations,
    clean_response,
    file_keys,
    one_to_one_violations,
)
from answerproof.operators.small import is_empty
from answerproof.session import written
from answerproof.sources.tables import LABELED_COLUMNS


def label_answers(
    df: DataFrame, th: Thresholds = RULES_ONLY, keep: Sequence[str] = (), where: Sequence[str] = ()
) -> DataFrame:
    """Label cleaned answers the way the batch job reports them.

    Both sides are stripped first, and blank answers count as abstentions: not hallucinated, with the
    reasoning still saying ``empty_response``. ``where``: conditions on the table's columns, applied to
    its scan.
    """
    for condition in where:
        df = df.filter(condition)
    stripped = df.withColumns(
        {"__answer": strip("model_response"), "__correct": strip("correct_answer")}
    )
    labelled = label_pairs(stripped, th, "__answer", "__correct")
    # working columns start with "__" and are gone; the stripped answer is blank iff the raw one is
    return labelled.withColumn(
        "hallucinated", abstention_rule("model_response", "hallucinated")
    ).select(*keep, *[F.col("reason").alias(c) if c == "reasoning" else c for c in LABELED_COLUMNS])


def label_responses(
    prompts: DataFrame,
    generations: DataFrame,
    th: Thresholds | None = None,
    run: str = "run",
    scores: DataFrame | None = None,
) -> DataFrame:
    """Prompts × raw generations → labelled responses: join, clean, decide, apply abstention.

    Rows belong to files: the keys are (run, source, id) where both tables have a source, and the
    labels keep it, so that they can be written by file. ``scores`` may hold ``embed_score``,
    ``nli_entail_min`` and ``nli_contradiction_max`` per key; scores that are given are used, unless
    ``th`` turns them off. Repeated keys of scores are refused. The joins shuffle, the rest is
    row-local.
    """
    file = file_keys(prompts, generations, run=run)
    joined = attach_generations(prompts, generations, run)
    if scores is not None:
        names = [
            c
            for c in (EMBED_SCORE, NLI_ENTAIL_MIN, NLI_CONTRADICTION_MAX)
            if c in scores.columns
        ]
        keys = [*file_keys(prompts, generations, scores, run=run), "id"]
        if not is_empty(one_to_one_violations(scores.select(*keys), keys)):
            raise ValueError(f"scores repeat {keys}")
        joined = joined.join(scores.select(*keys, *names), keys, "left")
        th = th or Thresholds(
            enable_embeddings=EMBED_SCORE in names,
            enable_nli=NLI_ENTAIL_MIN in names and NLI_CONTRADICTION_MAX in names,
        )
    cleaned = joined.withColumn("model_response", clean_response("model_response_raw", "prompt"))
    return label_answers(cleaned, th or RULES_ONLY, keep=file)


def report(
    labelled: DataFrame,
    source: str = "source",
    top_keywords: int = 10,
    replicates: int = 1000,
    seed: int = 0,
    stop_words: Sequence[str] = KEYWORD_STOPWORDS,
) -> dict[str, DataFrame]:
    """The tables of a run's report: processed rows, rates, keywords, correlations, metrics.

    All of them scan the labels, so those are written once to the shared checkpoint folder first.
    """
    rows = written(add_features(labelled), "report")
    metrics = resample.bootstrap_rate_ci(rows, [source], replicates, seed)
    return {
        "processed": rows.select("prompt", "model_response", "is_correct", "hallucinated"),
        "template": rates.rate_by_template(rows),
        "keywords": keywords.rate_by_keyword(rows, top_keywords, stop_words=stop_words),
        "correlation": rates.correlation_matrix(rows),
        "metrics": resample.metric_records(metrics, [source]),
    }


def audit_set(
    labelled: DataFrame,
    n_total: int = 300,
    seed: int = 1337,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """A balanced sample for reviewers out of the first files that hold enough of both labels.

    ``keys`` name a row; by default run, file and id. Repeated keys are refused, as such rows would be
    drawn together.
    """
    rows = audit.audit_rows(labelled)
    keys = keys or [*audit.file_columns(rows), "id"]
    pool = audit.pool_rows(rows, n_total)
    if not is_empty(one_to_one_violations(pool.select(*keys), keys)):
        raise ValueError(f"rows repeat {list(keys)}")
    drawn = audit.balanced_sample(pool, n_total, keys, seed)
    flags = ["detector_hallucinated", "human_hallucinated", "human_notes"]
    return drawn.select(*[c for c in drawn.columns if c not in flags], *flags)


def build_prompt_set(
    generations: DataFrame,
    ballots: DataFrame,
    per_seed: int,
    exact_total: int | None = None,
    resize_seed: int = 42,
) -> DataFrame:
    """A prompt set out of stored generations: ``template, id, prompt, correct_answer``.

    ``generations`` has one row per (seed_no, seed, attempt) and lists questions; ``ballots`` has the
    answers (question, answer, vote_no). Every seed must yield ``per_seed`` questions and every
    question an answer, otherwise nothing is built.
    """
    asked = harvest.harvest_questions(generations.select("seed_no", "seed", "attempt", "generation"))
    # question_no counts from 0 within one generation, so 32 bits hold it
    place = F.shiftleft(F.col("attempt").cast("bigint"), 32) + F.col("question_no")
    kept = harvest.dedupe_questions(asked.withColumn("position", place), per_seed)
    kept = written(kept, "questions")
    short = harvest.incomplete_seeds(kept, per_seed)
    # a seed listed twice is one seed, at its first place
    seeds = generations.groupBy("seed").agg(F.min("seed_no").alias("seed_no"))
    short = short.select("seed").unionByName(
        seeds.join(kept.select("seed").distinct(), "seed", "left_anti").select("seed")
    )
    if not is_empty(short):
        names = sorted(r[0] for r in short.limit(20).collect())
        raise ValueError(f"seeds without exactly {per_seed} questions: {names}")
    answered = kept.join(harvest.majority_vote(ballots), "question", "left").join(seeds, "seed")
    answered = answered.select(
        (F.shiftleft(F.col("seed_no").cast("bigint"), 32) + F.col("question_no")).alias(POSITION),
        F.col("seed").alias("template"),
        F.col("question").alias("prompt"),
        F.col("answer").alias("correct_answer"),
    )
    if not is_empty(harvest.blank_answers(answered)):
        raise ValueError("at least one question has no answer")
    numbered = number_rows(answered, [], POSITION, "id")
    if exact_total:
        numbered = resample.resize_prompts(numbered, exact_total, POSITION, seed=resize_seed)
    return numbered.select("template", "id", "prompt", "correct_answer")
