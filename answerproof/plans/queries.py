"""The registered queries: every operator, run over whole test tables.

Each entry takes (spark, folder of parquet tables) and returns a DataFrame. Fixture texts are built
in SQL that the oracle shares; what is checked is the operator applied to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerproof.config import RULES_ONLY, Thresholds
from answerproof.functions import flags, numeric, text
from answerproof.operators import score_store as score_store_jobs
from answerproof.operators import (
    audit,
    decide,
    harvest,
    keywords,
    rates,
    resample,
    schema,
    scores,
    signals,
    sweep,
)
from answerproof.operators.signals import w
from answerproof.plans import fixtures, jobs, views
from answerproof.session import shared_folder, spread, written
from answerproof.sources import keyed, tables
from answerproof.streaming import labelling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PRIORITIES = fixtures.PRIORITIES
SCORED = Thresholds()
LENIENT = Thresholds(strict_dependencies=False)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.add_signals(views.qa(spark, d), RULES_ONLY)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Batch labels of the qa view, with the columns reports group by."""
    return jobs.label_answers(views.qa(spark, d), keep=["model", "cluster_id"])


def _review(spark: SparkSession, d: str) -> DataFrame:
    return views.review(spark, d).withColumn("final_label", F.col("rater_a"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(views.read(spark, d, "documents"))


# ---- text comparison ------------------------------------------------------------------------


@query
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    return signals.add_canonical(views.qa(spark, d)).select(
        "id",
        w("resp").alias("normalized_response"),
        w("gold").alias("normalized_correct_answer"),
    )


@query
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", text.canonical("text").alias("can"))
    return docs.select(
        "doc_id",
        F.md5("can").alias("digest"),
        F.length("can").alias("n_chars"),
        text.token_count("can").alias("n_tokens"),
    )


@query
def lexical_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "id",
        w("exact").alias("baseline_exact"),
        w("substring").alias("normalized_substring"),
        w("subsequence").alias("token_subsequence"),
        F.round(w("jaccard"), 9).alias("jaccard"),
        text.shared_content_count(w("resp"), w("gold")).alias("shared_content"),
    )


@query
def cue_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "id",
        w("negated").alias("contradiction_heuristic"),
        w("unavailable").alias("unavailability_claim"),
        w("unavailability_conflict").alias("unavailability_conflict"),
    )


@query
def atomic_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "id",
        w("atomic_gold").alias("atomic_gold"),
        w("atomic_mismatch").alias("atomic_mismatch"),
    )


@query
def numeric_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "id",
        w("gold_num").alias("gold_number"),
        F.get(w("resp_nums"), F.lit(0)).alias("first_number"),
        F.size(w("resp_nums")).alias("n_numbers"),
        w("numeric_match").alias("numeric_match"),
    )


@query
def numeric_conflicts(spark: SparkSession, d: str) -> DataFrame:
    details = decide.label_pairs(views.qa(spark, d), RULES_ONLY, diagnostics=True)
    conflict = F.col("numeric_conflict_if_present")
    return details.select(
        "id", conflict["flag"].alias("numeric_conflict"), conflict["mode"].alias("mode")
    )


@query
def numeric_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "id",
        w("alternative_conflict").alias("alternative_conflict"),
        F.size(w("alternatives")).alias("n_differing"),
        F.get(w("alternatives"), F.lit(0)).alias("first_differing"),
    )


@query
def scientific_values(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(fixtures.POWERS, orders=spread(views.read(spark, d, "orders")))
    rows = rows.withColumn("can", text.canonical("answer"))
    rows = rows.withColumn("numtext", numeric.number_text("answer", "can"))
    rows = rows.withColumn("scientific", numeric.scientific("numtext"))
    return rows.select(
        "id",
        F.round("scientific", 9).alias("scientific"),
        F.size(numeric.numbers("numtext", "scientific")).alias("n_numbers"),
    )


@query
def coordinate_values(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(fixtures.PLACES, orders=spread(views.read(spark, d, "orders")))
    rows = rows.withColumn("can", text.canonical("answer"))
    return rows.select("id", numeric.coordinate(numeric.ascii_digits(F.col("can"))).alias("degrees"))


@query
def coordinate_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(fixtures.COORDINATES, orders=spread(views.read(spark, d, "orders")))
    found = decide.label_pairs(rows, RULES_ONLY, diagnostics=True)
    differing = F.coalesce(F.col("numeric_alternative_conflict.diff_alternatives"), F.array().cast("array<double>"))
    return found.select(
        "id", "numeric_match", "numeric.gold", "numeric.resp",
        F.col("numeric_conflict_if_present.flag").alias("conflict"),
        F.col("numeric_alternative_conflict.flag").alias("alternatives"),
        F.size(differing).alias("n_differing"), "reason",
    )


# ---- decisions ------------------------------------------------------------------------------

DECISION = (
    "id", "hallucinated", "accepted", "reason", "baseline_exact", "baseline_embed",
    "baseline_embed_score", "baseline_embed_method",
)


def _decision(df: DataFrame) -> DataFrame:
    rounded = F.round("baseline_embed_score", 9).alias("baseline_embed_score")
    return df.select(*[rounded if c == "baseline_embed_score" else c for c in DECISION])


@query
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _decision(decide.label_pairs(views.qa(spark, d), RULES_ONLY))


@query
def label_pairs_of_a_model(spark: SparkSession, d: str) -> DataFrame:
    """Conditions on the table reach its scan, those on the label stay above it."""
    conditions = ["model = 'm1'", "id % 2 = 0", "hallucinated"]
    return _decision(decide.label_pairs(views.qa(spark, d), RULES_ONLY, where=conditions))


@query
def flag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return decide.flag_pairs(views.qa(spark, d), RULES_ONLY).select("id", "hallucinated")


@query
def weak_signals(spark: SparkSession, d: str) -> DataFrame:
    details = decide.label_pairs(views.qa(spark, d), RULES_ONLY, diagnostics=True)
    return details.select("id", "weak_passes", "weak_required")


@query
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    labelled = decide.label_pairs(views.qa(spark, d), RULES_ONLY)
    return labelled.groupBy("reason", "hallucinated").agg(F.count(F.lit(1)).alias("n"))


@query
def label_responses(spark: SparkSession, d: str) -> DataFrame:
    qa = views.qa(spark, d).withColumnRenamed("model", "run")
    prompts = qa.select("run", "id", "template", "prompt", "correct_answer")
    raw = F.expr(fixtures.RAW_GENERATION).alias("model_response_raw")
    generations = qa.select("run", "id", raw)
    labelled = jobs.label_responses(prompts, generations)
    score = F.round("baseline_embed_score", 9)
    return labelled.withColumn("baseline_embed_score", score)


# ---- scores ---------------------------------------------------------------------------------


def _with_cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = views.read(spark, d, "embeddings")
    n = vectors.agg(F.count(F.lit(1))).scalar()
    keyed = views.qa(spark, d).withColumns(
        {"resp_vec": F.col("id") % n, "gold_vec": (F.col("id") * 7) % n}
    )
    return scores.pair_cosine(keyed, vectors, "resp_vec", "gold_vec")


def _with_nli(spark: SparkSession, d: str) -> DataFrame:
    return scores.attach_nli(views.qa(spark, d), views.nli(spark, d))


@query
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _with_cosine(spark, d).select("id", F.round("embed_score", 9).alias("embed_score"))


@query
def baseline_similarity(spark: SparkSession, d: str) -> DataFrame:
    lenient = Thresholds(enable_nli=False, strict_dependencies=False, embed_min_similarity=0.1)
    half = F.when(F.col("id") % 3 > 0, F.col("embed_score"))
    scored = _with_cosine(spark, d).withColumn("embed_score", half)
    return _decision(decide.label_pairs(scored, lenient)).select(
        "id", "baseline_embed", "baseline_embed_score", "baseline_embed_method"
    )


@query
def embedding_support(spark: SparkSession, d: str) -> DataFrame:
    th = Thresholds(enable_nli=False, embed_min_similarity=0.1)
    details = decide.label_pairs(_with_cosine(spark, d), th, diagnostics=True)
    return details.select("id", "embedding_gate", "embedding_match", "reason")


@query
def nli_veto(spark: SparkSession, d: str) -> DataFrame:
    th = Thresholds(enable_embeddings=False)
    details = decide.label_pairs(_with_nli(spark, d), th, diagnostics=True)
    return details.select(
        "id",
        F.round("nli_entail_min", 9).alias("nli_entail_min"),
        F.round("nli_contradiction_max", 9).alias("nli_contradiction_max"),
        "nli_contradiction_veto",
    )


@query
def label_with_scores(spark: SparkSession, d: str) -> DataFrame:
    both = scores.attach_nli(_with_cosine(spark, d), views.nli(spark, d))
    return _decision(decide.label_pairs(both, SCORED))


@query
def missing_scores(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("id") % 5 > 0, F.col("entailment"))
    nli = views.nli(spark, d).withColumn("entailment", known)
    pairs = scores.attach_nli(signals.add_canonical(views.qa(spark, d)), nli)
    needed = (w("resp") != "") & scores.nli_eligible(SCORED)
    return scores.missing_scores(pairs, F.col("nli_entail_min"), needed, "model")


@query
def scorer_hook(spark: SparkSession, d: str) -> DataFrame:
    names = ["normalized_response", "normalized_correct_answer"]
    pairs = canonical_pairs(spark, d)
    layout = "normalized_response string, normalized_correct_answer string, embed_score double"

    def make_scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
        """A stand-in for a model: how alike two texts are in length."""

        def alike(batch: pd.DataFrame) -> pd.DataFrame:
            a = batch["normalized_response"].str.len()
            b = batch["normalized_correct_answer"].str.len()
            return batch.assign(embed_score=a.where(a < b, b) / a.where(a > b, b).clip(lower=1))

        return alike

    def score(distinct: DataFrame) -> DataFrame:
        return scores.run_scorer(distinct, make_scorer, layout)

    scored = scores.score_distinct(pairs, names, score)
    return scored.select("id", F.round("embed_score", 9).alias("embed_score"))


def _length_scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in for an entailment model: probabilities out of the lengths of both texts."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = batch["premise"].str.len(), batch["hypothesis"].str.len()
        contradiction = (a * 37 + b * 11) % 101 / 100.0
        entailment = (1 - contradiction) * ((a * 53 + b * 7) % 101 / 100.0)
        return batch.assign(
            contradiction=contradiction, entailment=entailment, neutral=1 - contradiction - entailment
        )

    return score


GRIDS = {
    "nli_contradiction_veto": (0.0, 0.25, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 1.0),
    "nli_entailment_veto_floor": (0.0, 0.1, 0.2, 0.3, 0.5, 0.9),
    "embed_min_similarity": (-0.2, 0.0, 0.1, 0.2, 0.5, 0.72),
    "jaccard_min": (0.0, 0.1, 0.2, 0.25, 0.4, 0.5, 1.0),
}


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    half = F.when(F.col("id") % 3 > 0, F.round("embed_score", 9))
    scored = scores.attach_nli(_with_cosine(spark, d), views.nli(spark, d)).withColumn("embed_score", half)
    return sweep.threshold_sweep(scored, GRIDS, ["model"], LENIENT)


ENTAILMENT_ONLY = Thresholds(enable_embeddings=False)


@query
def score_store(spark: SparkSession, d: str) -> DataFrame:
    """Labels with kept scores, and how many pairs each run had to score: a part of the table first, then
    all of it, then all of it again."""
    qa, path = views.qa(spark, d), _folder(spark, "scores")
    runs = []
    for rows in (qa.filter("id % 3 = 0"), qa, qa):
        pairs = score_store_jobs.pairs_to_score(rows, ENTAILMENT_ONLY)
        runs.append(score_store_jobs.score_missing(pairs, path, _length_scorer))
    scored = score_store_jobs.attach_stored(qa, path, ENTAILMENT_ONLY)
    labelled = decide.label_pairs(scored, ENTAILMENT_ONLY, diagnostics=True)
    parts = {
        "nli_entailment": "nli_fwd.entailment", "nli_contradiction": "nli_fwd.contradiction",
        "nli_entailment_reverse": "nli_rev.entailment", "nli_contradiction_reverse": "nli_rev.contradiction",
    }
    return labelled.select(
        "id", "reason", "nli_contradiction_veto",
        *[F.round(c, 9).alias(name) for name, c in parts.items()],
        *[F.lit(n).cast("bigint").alias(f"scored_{i}") for i, n in enumerate(runs, 1)],
    )


@query
def flags_from_store(spark: SparkSession, d: str) -> DataFrame:
    """Flags alone need fewer pairs: those no rule has decided."""
    qa, path = views.qa(spark, d), _folder(spark, "scores")
    pairs = score_store_jobs.pairs_to_score(qa, ENTAILMENT_ONLY, for_reason=False)
    scored = score_store_jobs.score_missing(pairs, path, _length_scorer)
    flagged = decide.flag_pairs(score_store_jobs.attach_stored(qa, path, ENTAILMENT_ONLY), ENTAILMENT_ONLY)
    return flagged.select("id", "hallucinated", F.lit(scored).cast("bigint").alias("scored"))


# ---- shaping --------------------------------------------------------------------------------


@query
def normalize_prompts(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.sql(fixtures.PROMPT_FILES, orders=views.read(spark, d, "orders"))
    return schema.normalize_prompts(raw).drop(schema.POSITION)


@query
def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.sql(fixtures.PROMPT_FILES, orders=views.read(spark, d, "orders"))
    return schema.normalize_prompts(raw.drop("QID", "Topic")).drop(schema.POSITION)


@query
def wrap_prompts(spark: SparkSession, d: str) -> DataFrame:
    return views.qa(spark, d).select("id", schema.wrap_prompt("prompt").alias("wrapped_prompt"))


@query
def clean_responses(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(fixtures.RAW_GENERATION)
    return views.qa(spark, d).select(
        "id", schema.clean_response(raw, "prompt").alias("model_response")
    )


@query
def clean_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = views.read(spark, d, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    # the answer is the next turn, so an equi-join on both keys does; no long conversation is sorted
    answers = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    return answers.select(
        "conv_id", "turn", schema.clean_response("text", "prompt").alias("model_response")
    )


@query
def attach_generations(spark: SparkSession, d: str) -> DataFrame:
    qa = views.qa(spark, d).withColumnRenamed("model", "run")
    # some prompts without a generation, and one run with some that have two
    copies = F.expr("case when id % 11 = 0 then 0 when run = 'm3' and id % 100 = 1 then 2 else 1 end")
    generations = qa.select(
        "run", "id", F.explode(F.array_repeat("model_response", copies)).alias("model_response_raw")
    )
    joined = schema.attach_generations(qa.select("run", "id", "prompt"), generations)
    return joined.select("run", "id", "model_response_raw")


@query
def attach_keyed_generations(spark: SparkSession, d: str) -> DataFrame:
    """The same join on tables that are stored by their keys."""
    qa = views.qa(spark, d).withColumnRenamed("model", "run").withColumn("source", F.col("template"))
    tag = uuid.uuid4().hex
    stored = [
        keyed.save_keyed(side, f"{name}_{tag}", _folder(spark, name), 8)
        for name, side in (
            ("prompts", qa.select("run", "source", "id", "prompt")),
            ("generations", qa.filter("id % 11 > 0").select("run", "source", "id", F.col("model_response").alias("model_response_raw"))),
        )
    ]
    return schema.attach_generations(*stored).select("run", "source", "id", "model_response_raw")


@query
def one_to_one_violations(spark: SparkSession, d: str) -> DataFrame:
    return schema.one_to_one_violations(views.review(spark, d), ["category", "cluster_id"])


@query
def features(spark: SparkSession, d: str) -> DataFrame:
    told = views.qa(spark, d).withColumn("hallucinated", F.expr(fixtures.LABEL_TEXT))
    told = told.withColumn("model_response", F.expr("nullif(model_response, '')"))
    return schema.add_features(told, nan_length=3).select(
        "id", "prompt_length", "response_length", "hallucinated", "is_correct"
    )


@query
def validate_prompts(spark: SparkSession, d: str) -> DataFrame:
    return schema.validate_prompts(views.qa(spark, d).select("prompt"))


# ---- files ----------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def prompt_files(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "prompts")
    tables.write_prompts(views.qa(spark, d), out)
    paths = [r.path for r in tables.discover(spark, out, "*.csv").collect()]
    return tables.load_prompt_sets(spark, paths).select(*tables.PROMPT_COLUMNS)


@query
def labelled_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("prompts_"), F.substring("template", 1, 1), F.lit(".csv"))
    rows = views.qa(spark, d).withColumns({"run": F.col("model"), "source": name})
    out = _folder(spark, "labels")
    tables.write_labeled(jobs.label_answers(rows, keep=["run", "source"]), out)
    paths = [r.path for r in tables.discover(spark, out, "*.csv").collect()]
    back = tables.read_labeled(spark, paths)
    return schema.add_features(back).select(
        F.col("id").cast("bigint").alias("id"), "template", "prompt", "model_response",
        "correct_answer", "hallucinated", "reasoning", "response_length",
    )


@query
def metric_files(spark: SparkSession, d: str) -> DataFrame:
    metrics = resample.bootstrap_rate_ci(_labelled(spark, d), ["model"], 1000, seed=7)
    out = _folder(spark, "metrics")
    tables.write_metrics(resample.metric_records(metrics, ["model"]), out, "model")
    ends = F.col("hallucination_rate_ci95")
    return spark.read.json(out).select(
        "model", "hallucination_rate", "hallucinations", "n",
        ends[0].alias("ci_low"), ends[1].alias("ci_high"),
        F.col("bootstrap_samples").cast("int").alias("bootstrap_samples"),
        F.col("bootstrap_seed").cast("int").alias("bootstrap_seed"),
    )


@query
def audit_files(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "audit")
    tables.write_audit(audit_set(spark, d), out)
    paths = [r.path for r in tables.discover(spark, out, "*.csv").collect()]
    names = [*audit.AUDIT_COLUMNS, "source_file", "detector_hallucinated", "human_hallucinated", "human_notes"]
    # a part without rows has a header all the same
    cells = tables.read_cells(spark, paths, tables.header_of(tables.sample_file(spark, paths[0])))
    return cells.select(*names).withColumns(
        {"id": F.col("id").cast("bigint"), "detector_hallucinated": flags.as_bool("detector_hallucinated")}
    )


@query
def processed_files(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "processed")
    tables.write_processed(schema.add_features(_labelled(spark, d)), out)
    paths = [r.path for r in tables.discover(spark, out, "*.csv").collect()]
    cells = tables.read_cells(spark, paths, ["prompt", "model_response", "is_correct", "hallucinated"])
    return cells.select(
        "prompt", "model_response", F.col("is_correct").cast("int").alias("is_correct"),
        flags.as_bool("hallucinated").alias("hallucinated"),
    )


# ---- rates ----------------------------------------------------------------------------------


@query
def rate_overall(spark: SparkSession, d: str) -> DataFrame:
    return rates.rate(_labelled(spark, d))


@query
def rate_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rates.rate(_labelled(spark, d), "model")


@query
def rate_by_template(spark: SparkSession, d: str) -> DataFrame:
    return rates.rate_by_template(_labelled(spark, d))


@query
def rate_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    runs = _labelled(spark, d).withColumns(
        {"run": F.concat("model", F.lit("_r"), F.col("id") % 3), "category": F.col("template")}
    )
    return rates.rate_grouping_sets(runs)


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return rates.coverage(_labelled(spark, d), "model")


@query
def length_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = schema.add_features(_labelled(spark, d))
    return rates.correlation_matrix(rows).withColumn("r", F.round("r", 9))


@query
def sparse_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and label against the words of the prompts, as features of their own."""
    rows = schema.add_features(_labelled(spark, d))
    present = F.transform(keywords.words("prompt"), lambda t: F.concat(F.lit("contains_"), t))
    features = [f"contains_{t}" for t in ("dollars", "customer", "nation", "order", "placed", "absent")]
    found = rates.sparse_correlation(
        rows.withColumn("present", present), "present", features, ["prompt_length", "response_length"]
    )
    return found.withColumn("r", F.round("r", 9))


@query
def template_extremes(spark: SparkSession, d: str) -> DataFrame:
    return rates.template_extremes(_labelled(spark, d), run="model", top=2)


@query
def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    top = keywords.tfidf_keywords(written(_labelled(spark, d)), 10)
    return top.withColumn("weight", F.round("weight", 9))


@query
def rate_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    found = keywords.rate_by_keyword(written(_labelled(spark, d)), 10)
    return found.select("keyword", "hallucination_rate", "n")


@query
def rate_by_phrase(spark: SparkSession, d: str) -> DataFrame:
    phrases = spark.createDataFrame([(p,) for p in fixtures.PHRASES], "keyword string")
    return keywords.rate_by_phrase(_labelled(spark, d), phrases)


def _toxic_documents(spark: SparkSession, d: str) -> DataFrame:
    labels = views.read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    # a document without a label is not positive, but its words count
    return _documents(spark, d).join(labels, "doc_id", "left")


@query
def tfidf_documents(spark: SparkSession, d: str) -> DataFrame:
    top = keywords.tfidf_keywords(_toxic_documents(spark, d), 10, "text", "toxic")
    return top.withColumn("weight", F.round("weight", 9))


@query
def rate_by_keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    found = keywords.rate_by_keyword(_toxic_documents(spark, d), 10, "text", "toxic")
    return found.select("keyword", "hallucination_rate", "n")


# ---- audit samples --------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    name = F.format_string("responses_labeled_%02d.csv", F.col("cluster_id") % 50)
    return views.review(spark, d).withColumn("source_file", name)


@query
def strata_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.strata_counts(_files(spark, d), "source_file")


@query
def file_pool(spark: SparkSession, d: str) -> DataFrame:
    return audit.file_pool(_files(spark, d), 800)


@query
def balanced_audit_sample(spark: SparkSession, d: str) -> DataFrame:
    pool = audit.pool_rows(_files(spark, d), 800)
    drawn = audit.balanced_sample(pool, 800, ["id"])
    return drawn.select(
        "source_file", "id", "detector_hallucinated", "human_hallucinated", "human_notes"
    )


@query
def audit_set(spark: SparkSession, d: str) -> DataFrame:
    file = F.format_string("responses_labeled_%02d.csv", F.col("cluster_id") % 50)
    rows = written(_labelled(spark, d).withColumn("source_file", file))
    return jobs.audit_set(rows, 800, keys=["id"])


@query
def lopsided_audit_sample(spark: SparkSession, d: str) -> DataFrame:
    few = views.review(spark, d).withColumn("detector_hallucinated", F.expr("id % 401 = 0"))
    return audit.balanced_sample(few, 800, ["id"]).select("id", "detector_hallucinated")


@query
def sample_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    drawn = audit.sample_per_stratum(views.review(spark, d), ["category"], 50, ["id"])
    return drawn.select("category", "id")


PER_CATEGORY = 0.3


def _audited(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_sample(_review(spark, d), PER_CATEGORY)


@query
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    return audit.sampling_plan(_review(spark, d), PER_CATEGORY)


@query
def audit_weights(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).select(
        "id", "category", "detector_hallucinated", F.round("weight", 9).alias("weight")
    )


@query
def sampling_design(spark: SparkSession, d: str) -> DataFrame:
    return audit.sampling_design(_review(spark, d), _audited(spark, d))


@query
def audit_composition(spark: SparkSession, d: str) -> DataFrame:
    model = F.concat(F.lit("m"), F.col("cluster_id") % 4)
    # some rows without a flag, which count as negative
    flag = F.when(F.col("id") % 13 > 0, F.col("detector_hallucinated"))
    rows = _audited(spark, d).withColumns({"model": model, "detector_hallucinated": flag})
    return audit.composition(rows, PRIORITIES[:4], rest="other")


# ---- reviewer statistics --------------------------------------------------------------------


@query
def reason_attribution(spark: SparkSession, d: str) -> DataFrame:
    flagged = decide.label_pairs(views.qa(spark, d), RULES_ONLY).filter("hallucinated")
    return audit.reason_attribution(flagged, PRIORITIES, "template")


@query
def confusion_rollup(spark: SparkSession, d: str) -> DataFrame:
    return audit.confusion(_review(spark, d))


@query
def weighted_confusion(spark: SparkSession, d: str) -> DataFrame:
    table = audit.confusion(_audited(spark, d), weight="weight")
    return table.withColumns(
        {c: F.round(c, 6) for c in table.columns if c not in ("group", "n")}
    )


@query
def wilson_recall(spark: SparkSession, d: str) -> DataFrame:
    table = audit.wilson_by(_review(spark, d))
    return table.withColumns({c: F.round(c, 9) for c in ("wilson_low", "wilson_high")})


@query
def kappa_multiclass(spark: SparkSession, d: str) -> DataFrame:
    table = audit.cohen_kappa(views.review(spark, d))
    return table.withColumn("kappa", F.round("kappa", 9))


@query
def kappa_binary(spark: SparkSession, d: str) -> DataFrame:
    table = audit.cohen_kappa(views.review(spark, d), binary=True)
    return table.withColumn("kappa", F.round("kappa", 9))


@query
def audit_structure(spark: SparkSession, d: str) -> DataFrame:
    question = F.concat(F.lit("customer "), "cluster_id").alias("prompt")
    rows = _review(spark, d).select("*", question, F.col("rater_a").alias("model_response"))
    return audit.audit_structure(rows)


@query
def error_labels(spark: SparkSession, d: str) -> DataFrame:
    return audit.error_labels(_review(spark, d))


# ---- resampling -----------------------------------------------------------------------------


@query
def bootstrap_rate_ci(spark: SparkSession, d: str) -> DataFrame:
    return resample.bootstrap_rate_ci(_labelled(spark, d), ["model"], 1000, seed=7)


@query
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    table = resample.cluster_profiles(_review(spark, d), _audited(spark, d))
    return table.withColumns({c: F.round(c, 6) for c in ("fp", "neg")})


@query
def cluster_bootstrap_fpr(spark: SparkSession, d: str) -> DataFrame:
    found = resample.cluster_bootstrap_fpr(_review(spark, d), _audited(spark, d), 2000)
    return found.select("group", *[F.round(c, 9).alias(c) for c in found.columns if c != "group"])


def _prompt_set(spark: SparkSession, d: str) -> DataFrame:
    rows = views.read(spark, d, "orders").select(
        F.col("o_orderkey").alias(schema.POSITION),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("template"),
        F.concat(F.lit("order "), "o_orderkey").alias("prompt"),
    )
    return rows


@query
def resize_down(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompt_set(spark, d)
    half = rows.count() // 2
    return resample.resize_prompts(rows, half, schema.POSITION)


@query
def resize_up(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompt_set(spark, d)
    larger = rows.count() * 3 // 2
    return resample.resize_prompts(rows, larger, schema.POSITION)


# ---- stored generations ---------------------------------------------------------------------


@query
def harvest_questions(spark: SparkSession, d: str) -> DataFrame:
    stored = spark.sql(fixtures.GENERATIONS, orders=spread(views.read(spark, d, "orders")))
    return harvest.harvest_questions(stored)


@query
def harvest_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = views.read(spark, d, "conversations").filter("role = 'assistant'")
    asked = harvest.harvest_questions(turns.select("conv_id", "turn", "text"), "text")
    return asked.select("conv_id", "turn", "question_no", "question")


@query
def dedupe_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.sql(fixtures.ASKED, orders=views.read(spark, d, "orders"))
    return harvest.dedupe_questions(asked, 40)


@query
def incomplete_seeds(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.sql(fixtures.ASKED, orders=views.read(spark, d, "orders"))
    return harvest.incomplete_seeds(asked, 40)


@query
def blank_answers(spark: SparkSession, d: str) -> DataFrame:
    votes = spark.sql(fixtures.VOTES, orders=views.read(spark, d, "orders"))
    return harvest.blank_answers(votes, "answer").select("question", "vote_no")


@query
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = spark.sql(fixtures.VOTES, orders=views.read(spark, d, "orders"))
    return harvest.majority_vote(votes)


# ---- streaming ------------------------------------------------------------------------------


@query
def stream_running_rates(spark: SparkSession, d: str) -> DataFrame:
    layout = views.read(spark, d, "orders").schema
    orders = (
        spark.readStream.schema(layout).option("pathGlobFilter", "orders.parquet").parquet(d)
    )
    arriving = spark.sql(
        views.QA, orders=orders,
        customer=views.read(spark, d, "customer"), nation=views.read(spark, d, "nation"),
    )
    labelled = labelling.label_stream(arriving, keep=("model",))
    name = f"running_rates_{uuid.uuid4().hex}"
    # the sink holds one row per model
    run = (
        labelling.running_rates(labelled, "model")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", f"{shared_folder(spark)}/{name}")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.table(name)
