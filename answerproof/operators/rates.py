"""Rates, coverage, correlations and rankings over labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerproof.functions.bind import bound
from answerproof.functions.flags import flag_of, share
from answerproof.functions.text import strip, text_or_empty
from answerproof.operators.small import settle

LABEL = "hallucinated"


def rate(df: DataFrame, *by: str, label: str = LABEL) -> DataFrame:
    """Share, count and number of positive rows; the share is NULL when there are no rows."""
    flag = flag_of(df, label)
    return df.groupBy(*by).agg(
        share(flag).alias("hallucination_rate"),
        F.count_if(flag).alias("hallucinations"),
        F.count(F.lit(1)).alias("n"),
    )


def rate_by_template(df: DataFrame, template: str = "template", label: str = LABEL) -> DataFrame:
    """Rate per template, highest first; a missing template is a group of its own."""
    rates = df.groupBy(template).agg(share(flag_of(df, label)).alias("hallucination_rate"))
    return rates.orderBy(F.desc("hallucination_rate"), F.asc_nulls_first(template))


def rate_grouping_sets(
    df: DataFrame, model: str = "model", run: str = "run", category: str = "category",
    label: str = LABEL,
) -> DataFrame:
    """Rates by (model, run, category), (model, run) and (model) in one pass.

    ``level`` tells the three apart, since a rolled-up column is NULL just as a missing value is.
    """
    m, r, c = F.col(model), F.col(run), F.col(category)
    rows = df.select(m, r, c, flag_of(df, label).alias("__flag"))
    grouped = rows.groupingSets([[m, r, c], [m, r], [m]], m, r, c).agg(
        F.grouping_id().alias("__level"),
        share("__flag").alias("hallucination_rate"),
        F.count_if(F.col("__flag")).alias("hallucinations"),
        F.count(F.lit(1)).alias("n"),
    )
    level = F.when(F.col("__level") == 0, "category").when(F.col("__level") == 1, "run")
    return grouped.withColumn("level", level.otherwise("model")).drop("__level")


def coverage(
    df: DataFrame, *by: str, response: str = "model_response", label: str = LABEL
) -> DataFrame:
    """Share of non-blank responses, and the rate among them next to the overall rate."""
    answered = strip(text_or_empty(response)) != ""
    flag = flag_of(df, label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(answered).alias("answered"),
        share(answered).alias("coverage"),
        share(flag).alias("hallucination_rate"),
        F.avg(F.when(answered, flag.cast("double"))).alias("rate_if_answered"),
    )


def correlation_matrix(
    df: DataFrame, features: Sequence[str] | None = None, label: str = LABEL
) -> DataFrame:
    """Pearson correlation of every feature pair, label included, as (x, y, r) rows.

    One aggregation over the table; NULL where a column is constant. Default features: both lengths
    and every ``contains_*`` column.
    """
    if features is None:
        features = ["prompt_length", "response_length"]
        features += [c for c in df.columns if c.startswith("contains_")]
    names = [c for c in features if c in df.columns] + [label]
    values = {c: (flag_of(df, c) if c == label else F.col(c)).cast("double") for c in names}
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]

    def pearson(x: str, y: str) -> Column:
        a, b = values[x], values[y]
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        return F.when(
            varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        )

    row = df.agg(*[pearson(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"))
        for i, (x, y) in enumerate(pairs)
        for a, b in dict.fromkeys([(x, y), (y, x)])
    ]
    return row.select(F.inline(F.array(*cells)))


def sparse_correlation(
    df: DataFrame, present: str, features: Sequence[str], numbers: Sequence[str] = (), label: str = LABEL
) -> DataFrame:
    """Pearson correlation of many yes/no features with each other, with ``numbers`` and with the label.

    ``present`` is an array column with the names of the features a row has; repeats and names outside
    ``features`` do not count. A row emits the pairs of what it has, not one value for each pair of
    features, and one aggregation counts them: the shuffle carries pairs that occur. Rows (x, y, r) as
    of ``correlation_matrix`` over dense columns, with pairs that never occur together included.
    """
    dense = {c: F.col(c).cast("double") for c in numbers} | {label: flag_of(df, label).cast("double")}
    names = list(dict.fromkeys(features))
    if set(names) & set(dense):
        raise ValueError(f"both a feature and a number: {sorted(set(names) & set(dense))}")
    had = F.array_sort(F.array_intersect(F.coalesce(present, F.array().cast("array<string>")), F.array(*map(F.lit, names))))
    rows = df.select(had.alias("__had"), *[v.alias(f"__x{i}") for i, v in enumerate(dense.values())])

    def pairs(v: Column) -> Column:
        first = F.transform(
            v["had"],
            lambda a: F.transform(
                F.filter(v["had"], lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
        return F.flatten(first)

    xs = [F.col(f"__x{i}") for i in range(len(dense))]
    sums = [c for x in xs for c in (F.count(x), F.sum(x))]
    each = rows.select(F.explode_outer(bound({"had": F.col("__had")}, pairs)).alias("p"), *xs)
    met = each.filter("p is not null").groupBy("p.a", "p.b").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[c.cast("double") for c in sums]).alias("sums")
    )
    whole = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[c.cast("double") for x in xs for c in (F.count(x), F.sum(x), F.sum(x * x))]).alias("totals"),
    )
    met, total = settle(met), whole.first()
    rows_ = float(total["rows"])
    alone = met.filter("a = b").select(F.col("a").alias("f"), F.col("n").alias("n_f"), "sums")
    spark = df.sparkSession
    listed = spark.createDataFrame([(f,) for f in names], "f string") if names else None
    if listed is None:
        return correlation_matrix(df, list(numbers), label)
    known = listed.join(alone, "f", "left").withColumn("n_f", F.coalesce("n_f", F.lit(0)).cast("double"))
    # feature by feature: the list squared, as the matrix itself is
    grid = listed.select(F.col("f").alias("x"), F.explode(F.array(*map(F.lit, names))).alias("y"))
    sizes = known.select("f", "n_f")
    both = (
        grid.join(sizes.withColumnsRenamed({"f": "x", "n_f": "n_x"}), "x")
        .join(sizes.withColumnsRenamed({"f": "y", "n_f": "n_y"}), "y")
        .join(
            met.select("a", "b", F.col("n").cast("double").alias("n_xy")),
            (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")), "left",
        )
    )
    met_ = F.coalesce("n_xy", F.lit(0.0))
    spread = F.sqrt((F.col("n_x") * (rows_ - F.col("n_x"))) * (F.col("n_y") * (rows_ - F.col("n_y"))))
    plain = both.select(
        "x", "y", F.when(spread > 0, (rows_ * met_ - F.col("n_x") * F.col("n_y")) / spread).alias("r")
    )
    cells = []
    for i, c in enumerate(dense):
        n, s, ss = (float(v or 0) for v in total["totals"][3 * i : 3 * i + 3])
        n_f, s_f = (F.coalesce(F.get("sums", F.lit(2 * i + k)), F.lit(0.0)) for k in (0, 1))
        spread = F.sqrt((n * ss - s * s) * n_f * (n - n_f))
        r = F.when(spread > 0, (n * s_f - s * n_f) / spread)
        cells += [F.struct(F.col("f").alias("x"), F.lit(c).alias("y"), r.alias("r")),
                  F.struct(F.lit(c).alias("x"), F.col("f").alias("y"), r.alias("r"))]
    mixed = known.select(F.inline(F.array(*cells)))
    return plain.unionByName(mixed).unionByName(correlation_matrix(df, list(numbers), label))


def template_extremes(
    df: DataFrame, run: str = "run", template: str = "template", label: str = LABEL, top: int = 6
) -> DataFrame:
    """The templates with the highest and the lowest rate in each run, with their counts.

    Ranks the aggregated (run, template) rows, never the responses.
    """
    rates = rate(df, run, template, label=label)
    high = Window.partitionBy(run).orderBy(
        F.desc("hallucination_rate"), F.asc_nulls_first(template)
    )
    low = Window.partitionBy(run).orderBy(
        F.asc("hallucination_rate"), F.asc_nulls_first(template)
    )
    ranked = rates.withColumns(
        {"rank_high": F.row_number().over(high), "rank_low": F.row_number().over(low)}
    )
    return ranked.filter((F.col("rank_high") <= top) | (F.col("rank_low") <= top))
