"""Kept scores: each pair is scored once, and strict labels refuse rows without a score."""

import os
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from answerproof.config import RULES_ONLY, Thresholds
from answerproof.operators import audit, decide, score_store, scores, sweep
from answerproof.operators.decide import label_pairs
from answerproof.sources import tables

NLI = Thresholds(enable_embeddings=False)
ROWS = [
    ("the city of light in france", "paris is the capital city"),
    ("The city of light, in France!", "Paris is the capital city"),  # the same pair once canonical
    ("paris is the capital city", "the city of light in france"),  # the other way round
    ("short", "paris is the capital city"),
    ("it is not paris is the capital city", "paris is the capital city"),
    ("there is no such record here", "a long reference answer"),
    ("", "paris is the capital city"),
    (None, None),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "id int, p struct<model_response: string, correct_answer: string>").select("id", "p.*")


def counting_scorer(seen):
    def make():
        def score(batch):
            seen.add(len(batch))
            a = batch["premise"].str.len() / 100
            return batch.assign(entailment=0.1, contradiction=a, neutral=0.9 - a)

        return score

    return make


def test_pairs_are_scored_once_and_in_both_directions(spark, df, tmp_path):
    path, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    pairs = score_store.pairs_to_score(df, NLI)
    # copies are one pair, the other way round is another; short, negated and empty rows need none
    assert pairs.count() == 3
    assert score_store.score_missing(pairs.filter("gold like 'paris%'"), path, counting_scorer(seen)) == 1
    assert score_store.score_missing(pairs, path, counting_scorer(seen)) == 2
    assert score_store.score_missing(pairs, path, counting_scorer(seen)) == 0
    assert seen.value == 6
    kept = score_store.stored_scores(spark, path).collect()
    assert len(kept) == 3 and all(r["part"] == r["digest"][:2] for r in kept)
    got = {r["id"]: r for r in score_store.attach_stored(df, path, NLI).collect()}
    assert got[0]["nli_fwd"]["contradiction"] == got[1]["nli_fwd"]["contradiction"] == 0.27
    assert got[0]["nli_rev"]["contradiction"] == 0.25 and got[2]["nli_fwd"]["contradiction"] == 0.25
    assert got[0]["nli_contradiction_max"] == 0.27 and got[0]["nli_entail_min"] == 0.1
    assert all(got[i]["nli_fwd"] is None and got[i]["nli_entail_min"] is None for i in (3, 4, 6, 7))
    assert len(got) == len(ROWS)
    # everything a strict label needs is there
    assert label_pairs(score_store.attach_stored(df, path, NLI), NLI).count() == len(ROWS)


def test_flags_need_fewer_pairs(df):
    # the claim of non-existence is decided by a rule
    assert score_store.pairs_to_score(df, NLI, for_reason=False).count() == 2


def test_a_cut_off_append_is_made_good(spark, df, tmp_path):
    path, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    pairs = score_store.pairs_to_score(df, NLI)
    score_store.score_missing(pairs, path, counting_scorer(seen))
    # a store that lost one direction of a pair, and has another pair twice
    names = [*score_store.KEY, "dir", *score_store.PROBABILITIES]
    rows = spark.read.schema(score_store.SCORER_OUTPUT).parquet(path).select(names).collect()
    lost = rows[0]["digest"]
    left = [r for r in rows if not (r["digest"] == lost and r["dir"] == "rev")]
    left += [r for r in rows if r["digest"] != lost]
    broken = str(tmp_path / "broken")
    spark.createDataFrame(left, score_store.SCORER_OUTPUT).write.partitionBy("part").parquet(broken)
    assert score_store.stored_scores(spark, broken).count() == 2
    assert score_store.score_missing(pairs, broken, counting_scorer(seen)) == 1
    assert score_store.stored_scores(spark, broken).count() == 3
    whole = score_store.attach_stored(df, path, NLI)
    mended = score_store.attach_stored(df, broken, NLI)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mended.collect()))


def test_the_border_between_the_texts_counts(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("1:", "1"), ("", "1:1")], "a string, b string")
    assert df.select(score_store.pair_digest(F.col("a"), F.col("b"))).distinct().count() == 4


# strict policy, whatever is selected


def scored(df, **columns):
    return df.withColumns({n: F.expr(c) for n, c in columns.items()})


def test_strict_flags_fail_without_an_embedding(df):
    partly = scored(df, embed_score="if(id = 0, null, 0.5D)", nli_entail_min="0.5D", nli_contradiction_max="0.5D")
    for job in (
        lambda: decide.flag_pairs(partly).collect(),
        lambda: decide.flag_pairs(partly).select("id").collect(),
        lambda: decide.flag_pairs(partly).count(),
        lambda: label_pairs(partly).select("hallucinated").collect(),
        lambda: label_pairs(partly).agg(F.count_if("accepted")).collect(),
    ):
        with pytest.raises(PySparkException, match="embedding score missing"):
            job()
    assert decide.flag_pairs(partly, Thresholds(strict_dependencies=False)).count() == len(ROWS)
    assert decide.flag_pairs(partly, RULES_ONLY).count() == len(ROWS)
    empty = scored(df.filter("model_response = ''"), embed_score="cast(null as double)", nli_entail_min="cast(null as double)", nli_contradiction_max="cast(null as double)")
    assert decide.flag_pairs(empty).count() == 1


def test_strict_flags_need_an_entailment_only_where_no_rule_decides(df):
    rules = scored(df, nli_entail_min="if(id in (0, 1, 2), 0.5D, null)", nli_contradiction_max="if(id in (0, 1, 2), 0.5D, null)")
    assert decide.flag_pairs(rules, NLI).count() == len(ROWS)
    # its reason could be the veto
    with pytest.raises(PySparkException, match="entailment score missing"):
        label_pairs(rules, NLI).count()


def test_repeated_vector_keys_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [0.5, 0.5])], "vec_id int, embedding array<double>")
    pairs = spark.createDataFrame([(1, 1, 2)], "id int, r int, g int")
    with pytest.raises(ValueError, match="repeat"):
        scores.pair_cosine(pairs, vectors, "r", "g")
    assert scores.pair_cosine(pairs, vectors.limit(2), "r", "g").first()["embed_score"] == 0.0


# thresholds swept


def test_sweep_equals_one_label_run_for_each_value(spark, df):
    many = df.crossJoin(spark.range(40).select(F.col("id").alias("k"))).withColumns(
        {"g": F.expr("if(k % 7 = 0, null, k % 3)"), "embed_score": F.expr("if(k % 5 = 0, null, (k * 13 + id) % 41 / 40D)"),
         "nli_entail_min": F.expr("if(k % 6 = 0, null, (k * 7 + id) % 23 / 22D)"),
         "nli_contradiction_max": F.expr("if(k % 6 = 0, null, (k * 11 + id) % 19 / 18D)")}
    ).cache()
    lenient = Thresholds(strict_dependencies=False)
    grids = {"nli_contradiction_veto": [0.5, 0.0, 0.75, 1.0, 2.0, 0.5], "nli_entailment_veto_floor": [-1.0, 0.3, 0.6, 1.0],
             "embed_min_similarity": [0.0, 0.5, 0.72, 1.0], "jaccard_min": [0.0, 0.1, 0.4, 1.0]}
    got = {}
    for r in sweep.threshold_sweep(many, grids, ["g"], lenient).collect():
        key = (r["threshold"], r["value"], r["measure"], r["g"])
        assert key not in got
        got[key] = (r["n"], r["positives"], r["rate"])
    want = {}
    for name, grid in grids.items():
        for value in sorted(set(grid)):
            from dataclasses import replace

            table = label_pairs(many, replace(lenient, **{name: value}))
            counted = table.groupBy("g").agg(
                F.count("*").alias("n"), F.count_if("hallucinated").alias("hallucinated"),
                F.count_if("baseline_embed").alias("baseline_embed"),
                F.count_if(F.col("reason") == "embedding_support").alias("embedding_support"))
            for r in counted.collect():
                for threshold, measure in {(t, m) for t, _, m, _ in got if t == name}:
                    want[name, value, measure, r["g"]] = (r["n"], r[measure], r[measure] / r["n"])
    assert got == want


def test_sweep_reads_the_table_once(spark, tmp_path):
    spark.createDataFrame(ROWS[:3], "model_response string, correct_answer string").write.parquet(str(tmp_path / "t"))
    rows = scored(spark.read.parquet(str(tmp_path / "t")), nli_entail_min="0.1D", nli_contradiction_max="0.9D")
    table = sweep.threshold_sweep(rows, {"nli_contradiction_veto": [i / 100 for i in range(100)]}, th=NLI)
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["positives"] for r in table.filter("value <= 0.9").collect()} == {3}
    with pytest.raises(ValueError):
        sweep.threshold_sweep(rows, {"nli_min_tokens": [1.0]})


# flags and categories without a name; replaced prompt sets


def test_missing_flags_and_unnamed_categories_count(spark):
    df = spark.createDataFrame([("m", "a", None, "x"), ("m", "a", True, "x"), ("m", "a", False, "x"), ("m", "z", True, "x"), ("m", None, None, "x")],
                               "model string, category string, detector_hallucinated boolean, reason string")
    assert audit.composition(df, ["a", "b"], rest="rest").first().asDict() == {"model": "m", "a": "1/2", "b": "0/0", "rest": "1/1"}
    assert audit.reason_attribution(df, ["a"], rest="rest").first().asDict() == {"reason": "x", "a": 3, "rest": 2, "total": 5}


def test_a_prompt_set_is_there_at_any_moment(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("t", 1, "p", "a")], "template string, id long, prompt string, correct_answer string")
    out = str(tmp_path / "set")
    tables.write_prompts(df, out)
    tables.write_prompts(df.withColumn("prompt", F.lit("q")), out + "/")
    assert sorted(os.listdir(tmp_path)) == ["set"]
    assert [r["prompt"] for r in tables.load_prompt_sets(spark, [f"{out}/{f}" for f in os.listdir(out) if f.endswith(".csv")]).collect()] == ["q"]
    # a set whose new part cannot be moved into place comes back
    tag = uuid.uuid4()
    monkeypatch.setattr(tables.uuid, "uuid4", lambda: tag)
    real = tables._write_csv

    def vanishing(writer, path, *a, **k):
        real(writer, path, *a, **k)
        os.rename(path, path + ".gone")

    monkeypatch.setattr(tables, "_write_csv", vanishing)
    with pytest.raises(Exception):
        tables.write_prompts(df, out)
    assert os.path.isdir(out) and not os.path.exists(f"{out}.old-{tag.hex}")
