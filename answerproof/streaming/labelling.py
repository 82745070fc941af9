"""Labelling as responses arrive.

The decision is row-local, so the batch functions run on a stream unchanged; only the running rates
keep state, one counter row per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerproof.config import RULES_ONLY, Thresholds
from answerproof.plans.jobs import label_answers


def read_answers(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100
) -> DataFrame:
    """Cleaned answers from a folder that parquet files are added to."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def label_stream(
    answers: DataFrame, th: Thresholds = RULES_ONLY, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Labelled responses; append mode, no state."""
    return label_answers(answers, th, keep)


def running_rates(labelled: DataFrame, *by: str) -> DataFrame:
    """Rate per group so far; write in update or complete mode. State grows with the groups only."""
    return labelled.groupBy(*by).agg(
        F.avg(F.col("hallucinated").cast("double")).alias("hallucination_rate"),
        F.count_if("hallucinated").alias("hallucinations"),
        F.count(F.lit(1)).alias("n"),
    )
