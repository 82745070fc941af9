"""Audit samples and reviewer statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerproof.functions.flags import flag_of, hash_key
from answerproof.operators.distinct import distinct_counts, group_bitmaps, with_total
from answerproof.operators.ranking import join_on, take_by_hash
from answerproof.operators.rates import LABEL
from answerproof.operators.small import settle

AUDIT_COLUMNS = ("template", "id", "prompt", "correct_answer", "model_response")
POSITIVE_LABEL = "contradiction"
# Not a category: marks the row over all categories.
TOTAL = "ALL"


# ---- drawing the sample ---------------------------------------------------------------------


def audit_rows(df: DataFrame, source_file: str = "source_file", label: str = LABEL) -> DataFrame:
    """Columns a reviewer needs, with the detector's label as a boolean. Fails on missing columns."""
    missing = {"prompt", "correct_answer", "model_response", label} - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    kept = [c for c in AUDIT_COLUMNS if c in df.columns]
    run = ["run"] if "run" in df.columns else []
    return df.select(*run, source_file, *kept, flag_of(df, label).alias("detector_hallucinated"))


def file_columns(df: DataFrame, file: str = "source_file") -> list[str]:
    """What names a file: its name, and its run where there are runs."""
    return (["run"] if "run" in df.columns else []) + [file]


def strata_counts(df: DataFrame, *by: str, flag: str = "detector_hallucinated") -> DataFrame:
    """Rows the detector flags and rows it does not; a missing flag is none."""
    told = flag_of(df, flag)
    return df.groupBy(*by).agg(F.count_if(told).alias("positives"), F.count_if(~told).alias("negatives"))


def pool_goals(n_total: int) -> tuple[int, int]:
    """How many positive and negative rows make a pool comfortably large for a sample of n."""
    pos = n_total // 2
    neg = n_total - pos
    return max(2 * pos, pos + 25), max(2 * neg, neg + 25)


def file_pool(
    df: DataFrame, n_total: int, file: str = "source_file", flag: str = "detector_hallucinated"
) -> DataFrame:
    """Files, in order of run and name, up to and including the one with which both strata reach
    their goal. Files of the same name in different runs are different files.

    Running totals are taken over one row per file.
    """
    pos_goal, neg_goal = pool_goals(n_total)
    files = file_columns(df, file)
    before = Window.orderBy(*files).rowsBetween(Window.unboundedPreceding, -1)
    counted = strata_counts(df, *files, flag=flag).withColumns(
        {
            "positives_before": F.coalesce(F.sum("positives").over(before), F.lit(0)),
            "negatives_before": F.coalesce(F.sum("negatives").over(before), F.lit(0)),
        }
    )
    return counted.filter(
        (F.col("positives_before") < pos_goal) | (F.col("negatives_before") < neg_goal)
    )


def pool_rows(
    df: DataFrame, n_total: int, file: str = "source_file", flag: str = "detector_hallucinated"
) -> DataFrame:
    names = file_columns(df, file)
    files = settle(file_pool(df, n_total, file, flag).select(*names))
    return join_on(df, files, names, "left_semi")


def balanced_quotas(df: DataFrame, n_total: int, flag: str = "detector_hallucinated") -> DataFrame:
    """Two rows (flag, quota): half each; what one stratum lacks goes once to the one with more left."""
    pos_target = n_total // 2
    told = flag_of(df, flag)
    counts = df.agg(
        F.count_if(told).alias("pos"), F.count_if(~told).alias("neg")
    ).withColumns(
        {
            "n_pos": F.least("pos", F.lit(pos_target)),
            "n_neg": F.least("neg", F.lit(n_total - pos_target)),
        }
    )
    short = F.lit(n_total) - F.col("n_pos") - F.col("n_neg")
    to_pos = F.col("pos") - F.col("n_pos") > F.col("neg") - F.col("n_neg")
    quota_pos = F.when(to_pos, F.least("pos", F.col("n_pos") + short)).otherwise(F.col("n_pos"))
    quota_neg = F.when(~to_pos, F.least("neg", F.col("n_neg") + short)).otherwise(F.col("n_neg"))
    return counts.select(
        F.inline(
            F.array(
                F.struct(F.lit(True).alias(flag), quota_pos.alias("quota")),
                F.struct(F.lit(False).alias(flag), quota_neg.alias("quota")),
            )
        )
    )


def balanced_sample(
    df: DataFrame, n_total: int, keys: Sequence[str], seed: int = 1337,
    flag: str = "detector_hallucinated",
) -> DataFrame:
    """n rows, half of them positive as far as possible, in shuffled order, with reviewer columns.

    ``keys`` identify a row; the hash of seed and keys decides who is drawn and in which order.
    """
    df = df.withColumn(flag, flag_of(df, flag))
    keyed = df.withColumn("__h", hash_key(seed, *keys))
    quotas = settle(balanced_quotas(df, n_total, flag))
    drawn = take_by_hash(keyed, [flag], quotas, "quota", "__h")
    return (
        drawn.orderBy(hash_key(seed, F.lit("order"), *keys))
        .drop("__h")
        .withColumns({"human_hallucinated": F.lit(""), "human_notes": F.lit("")})
    )


def sample_per_stratum(
    df: DataFrame, strata: Sequence[str], k: int, keys: Sequence[str], seed: int = 1337
) -> DataFrame:
    """k rows of every stratum (all of a smaller one), chosen by hash."""
    keyed = df.withColumn("__h", hash_key(seed, *keys))
    quotas = settle(df.select(*strata).distinct()).withColumn("__quota", F.lit(k))
    return take_by_hash(keyed, strata, quotas, "__quota", "__h").drop("__h")


def sampling_plan(
    frame: DataFrame, per_category: int | float, category: str = "category",
    flag: str = "detector_hallucinated",
) -> DataFrame:
    """Per category: all positives, and negatives up to the category's audit size.

    ``per_category`` is a number of rows, or a share of the category below 1. ``p_negative`` is the
    probability that a negative row is drawn; audited negatives weigh its inverse.
    """
    size = F.col("positives") + F.col("negatives")
    target = (
        F.ceil(size * F.lit(per_category)) if per_category < 1 else F.lit(int(per_category))
    ).cast("bigint")
    quota = F.greatest(
        F.least(F.col("negatives"), target - F.col("positives")), F.lit(0).cast("bigint")
    )
    plan = strata_counts(frame, category, flag=flag).withColumn("audited_negatives", quota)
    return plan.withColumn(
        "p_negative",
        F.when(F.col("negatives") > 0, F.col("audited_negatives") / F.col("negatives")),
    )


def attach_weights(
    rows: DataFrame, plan: DataFrame, category: str = "category",
    flag: str = "detector_hallucinated",
) -> DataFrame:
    """Analysis weight of audited rows: 1 for positives, the inverse inclusion probability else."""
    joined = join_on(rows, plan.select(category, "p_negative"), [category], "left")
    inverse = F.when(F.col("p_negative") > 0, 1 / F.col("p_negative"))
    return joined.withColumn("weight", F.when(flag_of(rows, flag), 1.0).otherwise(inverse)).drop(
        "p_negative"
    )


def audit_sample(
    frame: DataFrame, per_category: int | float, keys: Sequence[str] = ("id",), seed: int = 42,
    category: str = "category", flag: str = "detector_hallucinated",
) -> DataFrame:
    """All positives and a simple random sample of negatives per category, with weights."""
    frame = frame.withColumn(flag, flag_of(frame, flag))
    plan = settle(sampling_plan(frame, per_category, category, flag))
    negatives = frame.filter(~F.col(flag)).withColumn("__h", hash_key(seed, *keys))
    drawn = take_by_hash(negatives, [category], plan, "audited_negatives", "__h").drop("__h")
    return attach_weights(frame.filter(flag).unionByName(drawn), plan, category, flag)


def sampling_design(
    frame: DataFrame, audited: DataFrame, category: str = "category", prompt: str = "cluster_id",
    flag: str = "detector_hallucinated",
) -> DataFrame:
    """Frame and audited counts per category, inclusion probability, distinct prompts in each."""

    def counts(df: DataFrame, prefix: str) -> DataFrame:
        told = flag_of(df, flag)
        rows = df.groupBy(category).agg(
            F.count_if(told).alias(f"{prefix}_positives"), F.count_if(~told).alias(f"{prefix}_negatives")
        )
        named = df.select(category, F.md5(F.col(prompt).cast("string").cast("binary")).alias("__prompt"))
        prompts = distinct_counts(group_bitmaps(named, [category], "__prompt"), [category], f"{prefix}_prompts")
        return join_on(rows, prompts, [category], "left").fillna(0, [f"{prefix}_prompts"])

    both = join_on(counts(frame, "frame"), counts(audited, "audited"), [category], "left")
    zero = {c: 0 for c in both.columns if c.startswith("audited")}
    return both.fillna(zero).withColumn(
        "p_negative",
        F.when(
            F.col("frame_negatives") > 0,
            F.col("audited_negatives") / F.col("frame_negatives"),
        ),
    )


# ---- reading the reviews --------------------------------------------------------------------


def is_contradiction(label: str = "final_label") -> Column:
    """Binary reading of a reviewer label: explicit contradiction or anything else."""
    return F.coalesce(F.col(label) == POSITIVE_LABEL, F.lit(False))


def _rollup_name(column: str) -> Column:
    """Group value, or TOTAL on the rolled-up row (a missing value stays NULL)."""
    return F.when(F.grouping(column) == 1, F.lit(TOTAL)).otherwise(F.col(column))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def _quality(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, specificity and false-positive rate from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": _ratio(tn, tn + fp),
            "fpr": _ratio(fp, tn + fp),
        }
    )


def confusion(
    df: DataFrame, by: str = "category", label: str = "final_label",
    flag: str = "detector_hallucinated", weight: str | None = None,
) -> DataFrame:
    """Detector against reviewers per group and in total; weighted sums if ``weight`` is named."""
    d, c = flag_of(df, flag), is_contradiction(label)

    def cell(condition: Column) -> Column:
        if weight is None:
            return F.count_if(condition)
        return F.sum(F.when(condition, F.col(weight)).otherwise(0.0))

    grouped = df.rollup(by).agg(
        _rollup_name(by).alias("group"),
        F.count(F.lit(1)).alias("n"),
        cell(d & c).alias("tp"),
        cell(d & ~c).alias("fp"),
        cell(~d & c).alias("fn"),
        cell(~d & ~c).alias("tn"),
    )
    return _quality(grouped.drop(by))


def _unnamed(category: str, categories: Sequence[str]) -> Column:
    """Rows of a category that has no column of its own, a missing one included."""
    return ~F.coalesce(F.col(category).isin(*categories), F.lit(False))


def reason_attribution(
    df: DataFrame, categories: Sequence[str], category: str = "category", reason: str = "reason",
    rest: str | None = None,
) -> DataFrame:
    """First triggering rule × category counts. Naming the categories saves a pass to find them.

    ``rest`` names a column for all other categories.
    """
    counts = [F.count_if(F.col(category) == c).alias(c) for c in categories]
    if rest is not None:
        counts.append(F.count_if(_unnamed(category, categories)).alias(rest))
    return df.groupBy(reason).agg(*counts, F.count(F.lit(1)).alias("total"))


def composition(
    df: DataFrame, categories: Sequence[str], model: str = "model", category: str = "category",
    flag: str = "detector_hallucinated", rest: str | None = None,
) -> DataFrame:
    """Per model, a "positive/negative" cell for each category; a missing flag is a negative one.

    ``rest`` names a column for all other categories.
    """
    told = flag_of(df, flag)
    columns = {c: F.col(category) == c for c in categories}
    if rest is not None:
        columns[rest] = _unnamed(category, categories)
    cells = [
        F.concat_ws("/", F.count_if(inside & told), F.count_if(inside & ~told)).alias(name)
        for name, inside in columns.items()
    ]
    return df.groupBy(model).agg(*cells)


def wilson_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval for k of n; NULL for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.greatest(centre - half, F.lit(0.0))
    high = F.least(centre + half, F.lit(1.0))
    return F.when(n > 0, low), F.when(n > 0, high)


def wilson_by(
    df: DataFrame, by: str = "category", label: str = "final_label",
    flag: str = "detector_hallucinated",
) -> DataFrame:
    """Recall of the detector per group with its Wilson interval."""
    table = confusion(df, by, label, flag).select(
        "group", F.col("tp").alias("k"), (F.col("tp") + F.col("fn")).alias("n")
    )
    low, high = wilson_interval(F.col("k"), F.nullif(F.col("n"), F.lit(0)))
    return table.withColumns(
        {"recall": _ratio(F.col("k"), F.col("n")), "wilson_low": low, "wilson_high": high}
    )


def cohen_kappa(
    df: DataFrame, rater_a: str = "rater_a", rater_b: str = "rater_b", by: str = "category",
    binary: bool = False,
) -> DataFrame:
    """Agreement and Cohen's kappa per group and overall; kappa is NULL when chance agreement is 1.

    The rows are counted by (group, label, label) when this is called; all else uses those counts.
    """
    a, b = F.col(rater_a), F.col(rater_b)
    if binary:
        a, b = is_contradiction(rater_a), is_contradiction(rater_b)
    rows = df.select(by, a.alias("__a"), b.alias("__b"))
    cells = (
        rows.groupingSets(
            [[F.col(by), F.col("__a"), F.col("__b")], [F.col("__a"), F.col("__b")]],
            by, "__a", "__b",
        )
        .agg(_rollup_name(by).alias("group"), F.count(F.lit(1)).alias("__n"))
        .select("group", "__a", "__b", "__n")
    )
    cells = settle(cells)
    totals = cells.groupBy("group").agg(
        F.sum("__n").alias("n"),
        F.sum(F.when(F.col("__a").eqNullSafe(F.col("__b")), F.col("__n")).otherwise(0)).alias("agree"),
    )
    left = cells.groupBy("group", F.col("__a").alias("__l")).agg(F.sum("__n").alias("__na"))
    right = cells.groupBy("group", F.col("__b").alias("__l")).agg(F.sum("__n").alias("__nb"))
    products = F.sum(F.col("__na").cast("double") * F.col("__nb"))
    chance = join_on(left, right, ["group", "__l"]).groupBy("group").agg(products.alias("__c"))
    joined = join_on(totals, chance, ["group"], "left")
    observed = F.col("agree") / F.col("n")
    expected = F.coalesce("__c", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(expected < 1, (observed - expected) / (1 - expected))
    return joined.select("group", "n", "agree", observed.alias("agreement"), kappa.alias("kappa"))


def audit_structure(
    df: DataFrame, by: str = "category", prompt: str = "prompt", response: str = "model_response",
    flag: str = "detector_hallucinated",
) -> DataFrame:
    """Rows, distinct prompts, distinct prompt-response pairs and positives, with a total.

    Texts are compared by 128-bit digests, so no text is shuffled, and the total merges the groups'
    bitmaps. A missing prompt is none. Groups are settled when this is called.
    """
    digest = {
        "__prompt": F.md5(F.col(prompt).cast("binary")),
        "__pair": F.md5(
            F.concat(*[F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("-")) for c in (prompt, response)])
        ),
        "__one": F.lit(1),
        "__told": flag_of(df, flag).cast("int"),
    }
    rows = df.withColumns(digest).select(by, *digest)
    found = with_total(
        rows, by, {"__prompt": "prompts", "__pair": "pairs"}, {"__one": "n", "__told": "positives"}, TOTAL
    )
    return found.select("group", "n", "prompts", "pairs", "positives")


def error_labels(
    df: DataFrame, label: str = "final_label", flag: str = "detector_hallucinated"
) -> DataFrame:
    """False positives and false negatives by final reviewer label."""
    told = flag_of(df, flag)
    wrong = told != is_contradiction(label)
    kind = F.when(told, "false_positive").otherwise("false_negative")
    return (
        df.filter(wrong)
        .groupBy(kind.alias("error"), F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
