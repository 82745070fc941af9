"""Registered queries against their SQL, and the stream against the batch."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

from answerproof.config import RULES_ONLY  # noqa: E402
from answerproof.plans import jobs, views  # noqa: E402
from answerproof.streaming import labelling  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check_oracles.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    ok, note = check_oracles.compare(spark, duck, sf_dir, name, oracle_sql()[name])
    assert ok, note


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark, sf_dir):
    rows = entry(spark).collect()
    assert len(rows) == 5 and all(0 <= r["hallucination_rate"] <= 1 for r in rows)


def test_cluster_bootstrap_brackets_the_estimate(spark, sf_dir):
    rows = queries()["cluster_bootstrap_fpr"](spark, sf_dir).collect()
    assert len(rows) == 6
    assert all(r["ci_low"] <= r["fpr"] <= r["ci_high"] for r in rows)


def test_stream_labels_like_the_batch(spark, sf_dir, tmp_path):
    qa = views.qa(spark, sf_dir)
    parts, out = str(tmp_path / "in"), str(tmp_path / "out")
    qa.repartition(4).write.parquet(parts)
    answers = labelling.read_answers(spark, parts, qa.schema, files_per_trigger=1)
    run = (
        labelling.label_stream(answers, RULES_ONLY)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    streamed = spark.read.parquet(out)
    batch = jobs.label_answers(qa)
    assert streamed.count() == qa.count()
    assert streamed.exceptAll(batch).count() == 0
