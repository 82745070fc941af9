"""A training corpus from ``documents``, in five stages that each take what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerproof.llm import common, contamination, line_runs, mixing, near_dups, toxicity
from answerproof.llm.queries import SOURCE_SHARES, learned_labels
from answerproof.session import scratch, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    common.bounded_batches(spark)
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"), learned_labels())


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; documents that have nothing left go with them.

    Documents without a word to begin with stay as they are. ``n_chars`` follows the text.
    """
    common.bounded_batches(spark)
    text, removed = common.free_name(docs, "kept_text"), common.free_name(docs, "removed")
    cut = line_runs.dedup_lines(docs)
    changed = F.size(removed) > 0
    cut = cut.filter(~changed | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    common.bounded_batches(spark)
    return near_dups.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark item go."""
    items = contamination.items_of(common.table(spark, sf_dir, "benchmark"))
    return contamination.drop_contaminated(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot, release, deadline and position in the mix."""
    return mixing.mix(docs, SOURCE_SHARES)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet and read again.

    What a stage writes on the way goes as soon as its result is there.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
