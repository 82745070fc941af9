"""Bootstrap intervals and resizing, reproducible on any cluster.

Randomness comes from hashes of (seed, replicate, ...), and rows are reduced to counts before any
replicate is made, so the cost depends on the number of replicates and not on the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerproof.functions.draws import binomial
from answerproof.functions.flags import flag_of, hash_key, hash_uniform, key_text
from answerproof.operators.audit import TOTAL, is_contradiction
from answerproof.operators.ranking import join_on, number_rows, take_first
from answerproof.operators.rates import LABEL
from answerproof.operators.small import settle

# Splits of a clustered resample that a task draws, about.
DRAWS_PER_TASK = 200_000
# Binomial outcomes further than this many standard deviations (and 50 counts) out have no mass
# a double can hold.
TAIL_SD = 9
# Replicate number of the estimate itself.
OBSERVED = -1


def interval_ranks(replicates: int) -> tuple[int, int]:
    """1-based ranks of the sorted replicates that bound the 95 % interval."""
    last = replicates - 1
    low = max(0, min(last, int(0.025 * replicates)))
    high = max(0, min(last, int(0.975 * replicates) - 1))
    return low + 1, high + 1


def bootstrap_rate_ci(
    df: DataFrame, by: Sequence[str], replicates: int, seed: int = 0, label: str = LABEL
) -> DataFrame:
    """Percentile interval of the positive rate of each group.

    Resampling n yes/no labels with replacement draws a Binomial(n, k/n) count. Each replicate has
    one hashed uniform number, and the count is its inverse distribution function. That function is
    monotone, so sorting the uniforms and inverting only the two that bound the interval gives
    exactly the interval of all sorted replicates. Without replicates there is no interval. The
    distribution function is tabulated around its mean: about sqrt(n) rows per group, whatever n is.
    The counts are settled when this is called.
    """
    if replicates < 0:
        raise ValueError("a number of replicates below 0")
    flag = flag_of(df, label)
    # one row per group, used three times below
    groups = settle(
        df.groupBy(*by).agg(
            F.count_if(flag).alias("hallucinations"), F.count(F.lit(1)).alias("n")
        )
    )
    if replicates == 0:
        plain = F.col("hallucinations").cast("double") / F.col("n")
        none = F.lit(None).cast("double")
        return groups.select(
            *by, plain.alias("hallucination_rate"), "hallucinations", "n", none.alias("ci_low"),
            none.alias("ci_high"), F.lit(0).alias("bootstrap_samples"), F.lit(seed).alias("bootstrap_seed"),
        )
    low, high = interval_ranks(replicates)
    draws = groups.select(*by, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__r"))
    ranked = draws.withColumn("__u", hash_uniform(seed, *by, "__r")).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*by).orderBy("__u", "__r"))
    )
    bounds = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("__rank") == low, F.col("__u"))).alias("__u_low"),
        F.max(F.when(F.col("__rank") == high, F.col("__u"))).alias("__u_high"),
    )
    k, n = F.col("hallucinations").cast("double"), F.col("n").cast("double")
    reach = F.ceil(TAIL_SD * F.sqrt(k * (n - k) / n)) + 50
    table = groups.withColumn(
        "__s",
        F.explode(
            F.sequence(
                F.greatest(F.col("hallucinations") - reach, F.lit(0).cast("bigint")),
                F.least(F.col("hallucinations") + reach, F.col("n")),
            )
        ),
    )
    # log of P(s) / P(s - 1); summed up it is log P(s) up to a constant
    step = F.ln((n - F.col("__s") + 1) * k / (F.col("__s") * (n - k)))
    upward = Window.partitionBy(*by).orderBy("__s")
    whole = Window.partitionBy(*by)
    first = F.min("__s").over(whole)
    mixed = (F.col("hallucinations") > 0) & (F.col("hallucinations") < F.col("n"))
    table = (
        table.filter(mixed)
        .withColumn("__step", F.when(F.col("__s") == first, 0.0).otherwise(step))
        .withColumn("__log", F.sum("__step").over(upward))
        .withColumn("__p", F.exp(F.col("__log") - F.max("__log").over(whole)))
        .withColumn("__cdf", F.sum("__p").over(upward) / F.sum("__p").over(whole))
    )
    inverted = join_on(table, bounds, by).groupBy(*by).agg(
        F.min(F.when(F.col("__cdf") >= F.col("__u_low"), F.col("__s"))).alias("__low"),
        F.min(F.when(F.col("__cdf") >= F.col("__u_high"), F.col("__s"))).alias("__high"),
    )
    # groups of one label only have no table: every replicate equals their rate
    result = join_on(groups, inverted, by, "left")
    return result.select(
        *by,
        (k / n).alias("hallucination_rate"),
        "hallucinations",
        "n",
        (F.coalesce("__low", "hallucinations") / n).alias("ci_low"),
        (F.coalesce("__high", "hallucinations") / n).alias("ci_high"),
        F.lit(replicates).alias("bootstrap_samples"),
        F.lit(seed).alias("bootstrap_seed"),
    )


def metric_records(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bootstrap rows in the shape of the metric files, the interval as an array.

    Rows without replicates are records of the rate alone: JSON leaves out what is NULL.
    """
    drawn = F.col("bootstrap_samples") > 0
    plain = ("hallucinations", "n", "bootstrap_samples", "bootstrap_seed")
    metrics = metrics.withColumns({c: F.when(drawn, F.col(c)) for c in plain[:2] + plain[3:]}).withColumn(
        "bootstrap_samples", F.when(F.col("bootstrap_samples") > 0, F.col("bootstrap_samples"))
    )
    return metrics.select(
        *by,
        "hallucination_rate",
        "hallucinations",
        "n",
        F.when(F.col("ci_low").isNotNull(), F.array("ci_low", "ci_high")).alias("hallucination_rate_ci95"),
        "bootstrap_samples",
        "bootstrap_seed",
    )


def cluster_profiles(
    frame: DataFrame,
    audited: DataFrame,
    category: str = "category",
    cluster: str = "cluster_id",
    label: str = "final_label",
    flag: str = "detector_hallucinated",
    weight: str = "weight",
) -> DataFrame:
    """Clusters of the frame counted by what they contribute to the false-positive rate.

    A cluster's contribution is its weighted number of false positives and of rows the reviewers call
    no contradiction. Clusters without an audited row contribute zero but are there to be drawn.
    Equal contributions are interchangeable in a resample, so only their number is kept.
    """
    negative = ~is_contradiction(label)
    zero = F.lit(0.0)
    known = audited.filter(negative).groupBy(category, cluster).agg(
        F.sum(F.when(flag_of(audited, flag), F.col(weight)).otherwise(zero)).alias("fp"),
        F.sum(weight).alias("neg"),
    )
    clusters = frame.select(category, cluster).distinct()
    sums = join_on(clusters, known, [category, cluster], "left").fillna(0.0, ["fp", "neg"])
    # sums of equal weights may differ in the last digit by order of addition
    rounded = sums.withColumns({"fp": F.round("fp", 9), "neg": F.round("neg", 9)})
    return rounded.groupBy(category, "fp", "neg").agg(F.count(F.lit(1)).alias("clusters"))


def _numbered(profiles: DataFrame, category: str) -> tuple[DataFrame, int]:
    """Profiles numbered from 0 within their category, and how many bits the numbers take.

    Numbers follow a hash of the contribution, so neighbours are unrelated and no task sorts a category.
    """
    amounts = [F.col(c).cast("decimal(38,9)") for c in ("fp", "neg")]
    keyed = profiles.withColumn("__h", hash_key(0, *amounts))
    numbered = number_rows(keyed, [category], "__h", "__no", hashed=True)
    numbered = settle(numbered.withColumn("__no", (F.col("__no") - 1).cast("bigint")).drop("__h"))
    return numbered, (numbered.agg(F.max("__no")).first()[0] or 0).bit_length()


def _splits(numbered: DataFrame, category: str, height: int) -> DataFrame:
    """How many clusters are below each node of a binary tree over the numbers, and below its left
    child. The node of a number at height h is the number without its last h bits."""
    each = numbered.select(
        category, "clusters", "__no", F.explode(F.sequence(F.lit(1), F.lit(height))).alias("__height")
    )
    node = F.expr("shiftright(__no, __height)")
    to_left = F.expr("shiftright(__no, __height - 1)") % 2 == 0
    return each.groupBy(category, "__height", node.alias("__node")).agg(
        F.sum("clusters").alias("__below"),
        F.sum(F.when(to_left, F.col("clusters")).otherwise(0)).alias("__left"),
    )


def cluster_replicates(
    profiles: DataFrame, replicates: int, seed: int = 42, category: str = "category"
) -> DataFrame:
    """Weighted false positives and negatives of every replicate of every category.

    Replicate -1 is the observed sample.

    Drawing C clusters with replacement is one multinomial draw over the distinct contributions. The
    draw is split down a binary tree of these: of the draws that reach a node, a binomial number goes to
    its left child. What is random in a split is a hash of (seed, category, replicate, node), so SQL can
    repeat the draw, and retries and other partitionings cannot change it. A split is one row, whatever the number of profiles; nodes no draw reaches have none.
    Numbers and splits (a row for each profile and level) are settled when this is called.
    """
    if replicates < 1:
        raise ValueError("a number of replicates below 1")
    zero = F.lit(0).cast("bigint")
    numbered, height = _numbered(profiles, category)
    sizes = numbered.groupBy(category).agg(
        F.sum("clusters").alias("__n"), F.sum(F.col("clusters") * F.col("fp")).alias("fp"),
        F.sum(F.col("clusters") * F.col("neg")).alias("neg"),
    )
    observed = sizes.select(category, F.lit(OBSERVED).cast("bigint").alias("replicate"), "fp", "neg")
    rows = sizes.select(
        category,
        F.explode(F.sequence(zero, zero + replicates - 1)).alias("replicate"),
        zero.alias("__no"),
        "__n",
    )
    # a draw costs far more than its row weighs, so the rows are spread by number and not by size
    cores = profiles.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(max(cores, replicates * max(1, 2**height // 2) // DRAWS_PER_TASK), "replicate", category)
    splits = settle(_splits(numbered, category, height)) if height else None
    for level in range(height, 0, -1):
        here = splits.filter(F.col("__height") == level).select(
            category, F.col("__node").alias("__no"), "__below", "__left"
        )
        left, below = F.col("__left"), F.col("__below")
        # the smaller side is drawn, the other one has the rest
        share = F.least(left, below - left) / below
        text = key_text(seed, category, "replicate", F.lit(level), "__no")
        drawn = F.when((left == 0) | (left == below), zero).otherwise(
            binomial(F.col("__n"), share, text)
        )
        split = join_on(rows, here, [category, "__no"]).withColumn("__drawn", drawn)
        to_left = F.when(left <= below - left, F.col("__drawn")).otherwise(F.col("__n") - F.col("__drawn"))
        split = split.withColumn("__to_left", to_left)
        children = F.array(
            F.struct((F.col("__no") * 2).alias("__no"), F.col("__to_left").alias("__n")),
            F.struct((F.col("__no") * 2 + 1).alias("__no"), (F.col("__n") - F.col("__to_left")).alias("__n")),
        )
        rows = split.select(category, "replicate", F.inline(children)).filter(F.col("__n") > 0)
    drawn = join_on(rows, numbered.select(category, "__no", "fp", "neg"), [category, "__no"])
    sums = drawn.groupBy(category, "replicate").agg(
        F.sum(F.col("__n") * F.col("fp")).alias("fp"), F.sum(F.col("__n") * F.col("neg")).alias("neg")
    )
    return sums.unionByName(observed)


def cluster_bootstrap_fpr(
    frame: DataFrame,
    audited: DataFrame,
    replicates: int = 10_000,
    seed: int = 42,
    category: str = "category",
    **columns: str,
) -> DataFrame:
    """Weighted false-positive rate per category and overall with a prompt-clustered 95 % interval."""
    profiles = cluster_profiles(frame, audited, category, **columns)
    drawn = cluster_replicates(profiles, replicates, seed, category)
    whole = F.grouping_id() == 1
    rates = (
        drawn.rollup("replicate", category)
        .agg(
            F.grouping_id().alias("__g"),
            F.when(whole, F.lit(TOTAL)).otherwise(F.col(category)).alias("group"),
            (F.sum("fp") / F.nullif(F.sum("neg"), F.lit(0.0))).alias("__rate"),
        )
        .filter(F.col("__g") < 2)
        .select("group", "replicate", "__rate")
    )
    low, high = interval_ranks(replicates)
    # one row per replicate and category
    observed = F.col("replicate") == OBSERVED
    order = Window.partitionBy("group", observed).orderBy("__rate", "replicate")
    ranked = rates.withColumn("__rank", F.row_number().over(order))
    bounds = ranked.groupBy("group").agg(
        F.max(F.when(observed, F.col("__rate"))).alias("fpr"),
        F.max(F.when(~observed & (F.col("__rank") == low), F.col("__rate"))).alias("ci_low"),
        F.max(F.when(~observed & (F.col("__rank") == high), F.col("__rate"))).alias("ci_high"),
    )
    return bounds.withColumns(
        {
            "specificity": 1 - F.col("fpr"),
            "specificity_low": 1 - F.col("ci_high"),
            "specificity_high": 1 - F.col("ci_low"),
        }
    )


def resize_prompts(
    df: DataFrame, total: int, position: str, id_col: str = "id", seed: int = 42
) -> DataFrame:
    """Exactly ``total`` rows, numbered 1..total.

    Too many rows: a sample without replacement, in hash order. Too few: all rows, then rows drawn
    with replacement. One count of the table decides which.
    """
    n = df.count()
    if n == 0:
        raise ValueError("cannot resize an empty prompt set")
    if n > total:
        keyed = df.withColumn("__h", hash_key(seed, position))
        kept = take_first(keyed, total, "__h").drop(id_col)
        return number_rows(kept, [], "__h", id_col, hashed=True).drop("__h", position)
    numbered = number_rows(df.drop(id_col), [], position, "__row")
    slots = df.sparkSession.range(1, total + 1).withColumnRenamed("id", id_col)
    drawn = F.floor(hash_uniform(seed, F.lit("extra"), id_col) * n) + 1
    slots = slots.withColumn("__row", F.when(F.col(id_col) <= n, F.col(id_col)).otherwise(drawn))
    return slots.join(numbered, "__row").drop("__row", position)
