"""Decisions, their reasons, score policies and plan shape."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from answerproof.config import RULES_ONLY, Thresholds
from answerproof.operators import decide, scores
from answerproof.plans import jobs

SCHEMA = "i int, model_response string, correct_answer string"

# response, gold, contradicts, reason
CASES = [
    ("Nihonium", "nihonium", False, "exact_match"),
    ("  paris  ", "Paris", False, "exact_match"),
    ("343 m/s", "343", False, "numeric_match"),
    ("À la recherche du temps perdu", "A la recherche du temps perdu", False, "exact_match"),
    ("90° S", "90 S", True, "numeric_conflict"),
    ("10^-21", "1e-21", True, "numeric_conflict"),
    ("sec-butyl alcohol", "sec-butanol", True, "atomic_entity_mismatch"),
    ("::1", "::1", False, "exact_match"),
    ("Paris, France", "Paris", False, "substring_match"),
    ("London", "Paris", True, "atomic_entity_mismatch"),
    ("It isn't Paris", "Paris", False, "substring_match"),
    ("It isnt Paris", "Paris", True, "contradiction_cue"),
    ("not Paris", "Paris", True, "contradiction_cue"),
    ("not the Paris", "Paris", False, "substring_match"),
    ("Paris was no capital", "Paris", True, "contradiction_cue"),
    ("Parisian is not it", "Paris", False, "substring_match"),
    ("1984 or 1985", "1984", True, "numeric_alternative_conflict"),
    ("There is no such element", "Nihonium", True, "unavailability_claim_conflicts_with_gold"),
    ("there is no such nihonium", "nihonium", False, "substring_match"),
    ("it does not exist as a whole in any of the books", "nihonium", True, "unavailability_claim_conflicts_with_gold"),
    ("", "Paris", True, "empty_response"),
    ("!!!", "Paris", True, "empty_response"),
    ("", "", True, "empty_response"),
    (None, "Paris", True, "empty_response"),
    ("Paris", None, False, "no_contradiction_evidence"),
    ("red big balloon", "red balloon", False, "token_subsequence_match"),
    ("I would have to look it up for you", "Paris", False, "no_contradiction_evidence"),
    ("packets in a loop", "packets from circulating indefinitely", False, "no_contradiction_evidence"),
    ("a.b", "the answer", False, "no_contradiction_evidence"),
]


def table(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    df = table(spark, [c[:2] for c in CASES])
    rows = decide.label_pairs(df, RULES_ONLY, diagnostics=True).collect()
    return {r["i"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}|{c[1]}" for c in CASES])
def test_case(labelled, i):
    row, (_, _, contradicts, reason) = labelled[i], CASES[i]
    assert (row["hallucinated"], row["reason"]) == (contradicts, reason)
    assert row["accepted"] is (not contradicts)


def test_empty_response_has_no_signals(labelled):
    row = labelled[next(i for i, c in enumerate(CASES) if c[3] == "empty_response")]
    assert row["baseline_embed_method"] == "none" and row["baseline_embed_score"] is None
    assert row["baseline_exact"] is False and row["baseline_embed"] is False
    assert row["jaccard"] is None and row["numeric"] is None and row["weak_passes"] is None


def test_diagnostics_have_one_schema(labelled):
    row = labelled[next(i for i, c in enumerate(CASES) if c[0] == "1984 or 1985")]
    assert row["numeric"].asDict() == {
        "used": True, "mode": "numeric", "gold": 1984.0, "resp": 1984.0, "matched": True
    }
    assert row["numeric_alternative_conflict"]["diff_alternatives"] == [1985.0]
    assert row["numeric_conflict_if_present"]["any_match"] is True


def test_flag_equals_label(spark):
    df = table(spark, [c[:2] for c in CASES])
    flags = {r["i"]: r["hallucinated"] for r in decide.flag_pairs(df, RULES_ONLY).collect()}
    assert flags == {i: c[2] for i, c in enumerate(CASES)}


def test_a_text_never_contradicts_itself(spark):
    texts = ["Paris", "no", "not", "1984 or 1985?", "there is no such thing", "ABC-12", "naïve café",
             "10^-21", "either 3 or 4", "is not", "x=1:2", "no no"]
    rows = decide.label_pairs(table(spark, [(t, t) for t in texts]), RULES_ONLY).collect()
    # two numbers offered as alternatives differ from the first, and repeated negators negate
    odd = {"no no"}
    for r in rows:
        if r["model_response"] not in odd:
            assert r["baseline_exact"] and not r["hallucinated"], r


def test_batch_labels_count_blank_answers_as_abstentions(spark):
    df = table(spark, [("", "Paris"), ("  ", "Paris"), ("!!!", "Paris"), ("London", " Paris ")])
    df = df.select(F.col("i").alias("id"), F.lit("t").alias("template"), F.lit("q").alias("prompt"),
                   "model_response", "correct_answer")
    rows = {r["id"]: r for r in jobs.label_answers(df).collect()}
    assert [rows[i]["hallucinated"] for i in range(4)] == [False, False, True, True]
    assert [rows[i]["reasoning"] for i in range(4)] == ["empty_response"] * 3 + ["atomic_entity_mismatch"]


def test_thresholds_change_the_outcome(spark):
    df = table(spark, [("1984 and/or 1985", "1984"), ("London town", "Paris"), ("gone fishing", "carp")])
    strict = Thresholds(enable_embeddings=False, enable_nli=False, atomic_resp_max_tokens=1,
                        numeric_alt_markers=("and/or",), unavailability_cues=("gone fishing",))
    reasons = [r["reason"] for r in decide.label_pairs(df, strict).orderBy("i").collect()]
    assert reasons == ["numeric_alternative_conflict", "no_contradiction_evidence",
                       "unavailability_claim_conflicts_with_gold"]


LONG = [("the cat sat on a mat", "the dog lay on a rug"), ("short", "the dog lay on a rug"), ("", "x")]


def with_scores(spark, embed, entail, contra):
    df = table(spark, LONG)
    return df.withColumns(
        {"embed_score": F.lit(embed), "nli_entail_min": F.lit(entail), "nli_contradiction_max": F.lit(contra)}
    )


def test_nli_veto_needs_both_bounds_and_enough_tokens(spark):
    def first_two(entail, contra):
        rows = decide.label_pairs(with_scores(spark, 0.1, entail, contra), Thresholds()).orderBy("i").collect()
        return [r["reason"] for r in rows[:2]]

    assert first_two(0.30, 0.75) == ["nli_contradiction_veto", "no_contradiction_evidence"]
    assert first_two(0.31, 0.75)[0] == "no_contradiction_evidence"
    assert first_two(0.30, 0.74)[0] == "no_contradiction_evidence"


def test_embedding_support_is_gated(spark):
    df = table(spark, [("wide river bank", "river shore"), ("lake", "river shore"), ("a big river", "river")])
    df = df.withColumn("embed_score", F.lit(0.9))
    th = Thresholds(enable_nli=False)
    rows = decide.label_pairs(df, th, diagnostics=True).orderBy("i").collect()
    assert [r["embedding_gate"] for r in rows] == [None, "insufficient_shared_content", "gold_too_short"]
    assert rows[0]["reason"] == "embedding_support"
    assert [r["baseline_embed_method"] for r in rows] == ["embedding"] * 3


def test_strict_policy_fails_on_missing_scores(spark):
    df = table(spark, LONG)
    with pytest.raises(ValueError, match="embed_score"):
        decide.label_pairs(df, Thresholds())
    partly = with_scores(spark, 0.5, 0.5, 0.5).withColumn("embed_score", F.expr("if(i = 0, null, 0.5D)"))
    with pytest.raises(PySparkException, match="embedding score missing"):
        decide.label_pairs(partly, Thresholds()).collect()
    # an empty response needs no score, nor does a pair that is too short for an entailment model
    fine = with_scores(spark, 0.5, 0.5, 0.5).withColumns(
        {"embed_score": F.expr("if(i = 2, null, 0.5D)"), "nli_entail_min": F.expr("if(i > 0, null, 0.5D)"),
         "nli_contradiction_max": F.expr("if(i > 0, null, 0.5D)")}
    )
    assert decide.label_pairs(fine, Thresholds()).count() == 3


def test_preflight_counts_missing_scores(spark):
    with pytest.raises(RuntimeError, match="'embedding': 2, 'entailment': 1"):
        decide.preflight(table(spark, LONG), Thresholds())
    decide.preflight(with_scores(spark, 0.5, 0.5, 0.5), Thresholds())
    decide.preflight(table(spark, LONG), RULES_ONLY)


def test_lenient_policy_falls_back_to_overlap(spark):
    rows = decide.label_pairs(table(spark, LONG), Thresholds(strict_dependencies=False)).orderBy("i").collect()
    assert [r["baseline_embed_method"] for r in rows] == ["jaccard", "jaccard", "none"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labelling_stays_in_the_jvm_and_shuffles_nothing(spark):
    plan = physical(decide.label_pairs(table(spark, LONG), RULES_ONLY))
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "Exchange" not in plan


def test_job_shuffles_only_for_its_join(spark):
    rows = spark.range(100).selectExpr("'r' as run", "id", "'t' as template", "'q' as prompt", "'a' as correct_answer")
    gens = spark.range(100).selectExpr("'r' as run", "id", "'a' as model_response_raw")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(jobs.label_responses(rows, gens))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


def test_filter_on_the_label_is_not_pushed_into_the_signals(spark):
    plan = physical(decide.label_pairs(table(spark, LONG), RULES_ONLY).filter("hallucinated"))
    assert plan.index("Filter hallucinated") < plan.index("CollectMetrics")


def test_pairs_are_scored_once(spark):
    df = table(spark, [("a", "b")] * 50 + [("c", "d")])
    seen = spark.sparkContext.accumulator(0)

    def make():
        def score(batch):
            seen.add(len(batch))
            return batch.assign(embed_score=0.5)

        return score

    keys = ["model_response", "correct_answer"]
    layout = "model_response string, correct_answer string, embed_score double"
    out = scores.score_distinct(df, keys, lambda p: scores.run_scorer(p, make, layout))
    assert out.filter("embed_score = 0.5").count() == 51
    assert seen.value == 2
