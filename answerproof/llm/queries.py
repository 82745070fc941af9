"""The registered queries of this folder, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerproof.llm import (
    alignment,
    ball_tree,
    contamination,
    fixity,
    languages,
    line_runs,
    mixing,
    near_dups,
    packing,
    quality,
    secret_spans,
    toxicity,
    units,
)
from answerproof.llm.common import fold, table

#: Shares of the sources in the mix; sources not named here have a share of 1.
SOURCE_SHARES = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated passages, with what is left and the spans cut out."""
    return units.dedup_units(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with passage, score and overlaps."""
    items = contamination.items_of(table(spark, sf_dir, "benchmark"))
    found = contamination.contaminated(table(spark, sf_dir, "documents"), items)
    return found.withColumn("item_id", F.col("item_id").cast("bigint"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = languages.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of near duplicates and whether it is the one that stays."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its place in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), SOURCE_SHARES)


def learned_labels():
    """Rows of ``labels`` that toxicity may learn from."""
    return F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), learned_labels())
    scored = toxicity.score_documents(docs, index)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "toxicity.score", "toxicity.predicted", "toxicity.neighbours", "toxicity.evidence"
    )


def second_copy(pages: DataFrame) -> DataFrame:
    """A replica of the pages that has decayed: one in 256 has a changed character in the middle."""
    name = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    at = F.floor(F.length("html") / 2).cast("int")
    worn = F.concat(F.expr("substring(html, 1, floor(length(html) / 2))"), F.lit("\x00"), F.expr("substring(html, floor(length(html) / 2) + 2)"))
    return pages.withColumn("html", F.when(name.startswith("00") & (at > 0), worn).otherwise(F.col("html")))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of all archives of two replicas, and the records that differ; those that only moved, by runs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity.fold_shifted(fixity.audit(fixity.archived(pages), fixity.archived(second_copy(pages))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with what is left of its text and the numbers of the lines cut out."""
    found = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.scan(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces of the training sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut each document."""
    return alignment.align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_decontamination,
        op3_language_id,
        op4_quality_rules,
        op5_near_dedup,
        op6_source_mixing,
        op7_toxicity,
        op8_warc_fixity,
        op9_line_dedup,
        op10_secret_scan,
        op11_packing,
        op12_lexical_search,
        op13_tokenizer_alignment,
        pipeline,
    )
}
