"""Which words mark the prompts that go wrong: TF-IDF keywords and the rate per keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.config import KEYWORD_STOPWORDS
from answerproof.functions.bind import bound
from answerproof.functions.flags import flag_of, share
from answerproof.functions.text import text_or_empty
from answerproof.operators.small import settle

# Fixed value: a word of the report.
WORD = r"(?U)\b[a-zA-Z]{2,}\b"

LABEL = "hallucinated"

# Counters of the frequency summary of a task, and candidates it names for each word wanted.
TRACKED_WORDS = 65_536
CANDIDATES = 4


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(WORD), F.lit(0))


def _counted_words(
    df: DataFrame, prompt: str, stop_words: Sequence[str], among: Sequence[str] | None = None
) -> DataFrame:
    """Total count and number of documents per word, in one pass over the texts.

    Every word is emitted once per occurrence and once more per document; both are summed by word
    with map-side combining, so the shuffle carries vocabularies, not texts. ``among``: only these words,
    and the shuffle carries no more than these for each task.
    """

    def emitted(v: Column) -> Column:
        return F.concat(
            F.transform(v["toks"], lambda t: F.struct(t.alias("term"), F.lit(0).alias("first"))),
            F.transform(
                F.array_distinct(v["toks"]), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first"))
            ),
        )

    flat = df.select(F.inline(bound({"toks": words(prompt)}, emitted)))
    if stop_words:
        flat = flat.filter(~F.col("term").isin(*stop_words))
    if among is not None:
        flat = flat.filter(F.col("term").isin(*among))
    return flat.groupBy("term").agg(
        F.count_if(F.col("first") == 0).alias("total"), F.sum("first").alias("df")
    )


def _frequent_words(
    df: DataFrame, size: int, prompt: str, stop_words: Sequence[str], tracked: int
) -> tuple[list[str], int]:
    """Words that may be among the ``size`` most frequent, and a count that no other word exceeds.

    Each task sums up its words in a summary of at most ``tracked`` counters, and the summaries are
    merged: what is shuffled does not depend on how many different words there are. An estimate is never
    below the count it stands for. With a total of N words, a word without a counter has at most
    3.5 N / tracked, and one whose counter is no proof that it is frequent at most twice that.
    """
    wanted = min(CANDIDATES * size, tracked)
    flat = df.select(F.explode(words(prompt)).alias("term"))
    if stop_words:
        flat = flat.filter(~F.col("term").isin(*stop_words))
    summary = F.expr(f"approx_top_k(term, {wanted}, {tracked})")
    found, total = flat.agg(summary.alias("found"), F.count(F.lit(1)).alias("total")).first()
    others = 2 * 3.5 * total / tracked
    if found and len(found) == wanted:
        others = max(others, found[-1]["count"])
    return [x["item"] for x in found or ()], others


def vocabulary(
    df: DataFrame, size: int, prompt: str = "prompt", stop_words: Sequence[str] = KEYWORD_STOPWORDS,
    tracked: int = TRACKED_WORDS,
) -> DataFrame:
    """The ``size`` most frequent words with total, document frequency and smoothed idf.

    A summary of bounded size names candidates, and a second pass counts these exactly. If the last
    word of the list is more frequent than any word left out can be, the list is the one a full count
    gives; where the counts are too flat for that proof, all words are counted. Candidates and counts are
    settled when this is called.
    """
    candidates, others = _frequent_words(df, size, prompt, stop_words, tracked)
    first = F.desc("total"), F.asc("term")
    counts = _counted_words(df, prompt, stop_words, candidates) if len(candidates) >= size else None
    top = settle(counts.orderBy(*first).limit(size)) if counts is not None else None
    # a word of the same count could come first by name, so only a larger count is a proof
    if top is None or not (top.agg(F.min("total")).first()[0] or 0) > others:
        top = _counted_words(df, prompt, stop_words).orderBy(*first).limit(size)
    docs = df.agg(F.count(F.lit(1))).scalar()
    return top.withColumn("idf", F.log((1 + docs) / (1 + F.col("df"))) + 1)


def tfidf_keywords(
    df: DataFrame,
    top_n: int = 10,
    prompt: str = "prompt",
    label: str = LABEL,
    stop_words: Sequence[str] = KEYWORD_STOPWORDS,
) -> DataFrame:
    """The top words by mean TF-IDF weight over positive prompts (``keyword, weight``).

    The vocabulary is capped at 5 × top_n words by total count, and rows are L2-normalised. It is
    fetched when this is called (5 × top_n words at most) and becomes a literal, so that each prompt is
    weighed by itself: rows need no key, and only sums by word are shuffled.
    """
    vocab = [(r["term"], r["idf"]) for r in vocabulary(df, 5 * top_n, prompt, stop_words).collect()]
    schema = "keyword string, weight double"
    if not vocab:
        return df.sparkSession.createDataFrame([], schema)
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("idf")) for t, i in vocab])
    known = F.array(*[F.lit(t) for t, _ in vocab])

    def weighed(v: Column) -> Column:
        return F.transform(
            terms,
            lambda term: F.struct(
                term["term"].alias("keyword"),
                (F.size(F.filter(v["toks"], lambda t: t == term["term"])) * term["idf"]).alias("w"),
            ),
        )

    toks = F.filter(words(prompt), lambda t: F.array_contains(known, t))
    cells = df.filter(flag_of(df, label)).select(bound({"toks": toks}, weighed).alias("cells"))
    normed = cells.withColumn(
        "norm", F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    )
    # a word that no positive prompt has takes part with weight 0; a prompt without words counts
    weights = (
        # an outer explode: for a plain one a filter on the cells is inferred, which would be pushed below
        # the caller's joins and weigh every row of the table
        normed.select("norm", F.inline_outer("cells"))
        .groupBy("keyword")
        .agg(
            F.sum(F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0)).alias("w"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("keyword", (F.col("w") / F.col("n")).alias("weight"))
    )
    # rounded, so that the order in which weights were added up does not decide ties
    return weights.orderBy(F.desc(F.round("weight", 12)), F.asc("keyword")).limit(top_n)


def keyword_matches(
    df: DataFrame, keywords: DataFrame, prompt: str = "prompt", carry: Sequence[str] = (LABEL,)
) -> DataFrame:
    """Rows × keywords their prompt contains as a whole word, in any case.

    A keyword of the report is itself a word, so containment is equality with one of the prompt's
    words: an equi-join instead of a pattern match per keyword.
    """
    # an outer explode, so that no filter on the words is inferred and evaluates them once more
    exploded = df.select(*carry, F.explode_outer(F.array_distinct(words(prompt))).alias("keyword"))
    return exploded.join(keywords.select("keyword"), "keyword")


# Borders between runs of word characters and runs of others.
BORDER = r"(?U)\b"


def segments(text: Column | str) -> Column:
    """A text in lower case as runs of word characters and runs of others, one after the other."""
    return F.filter(F.split(F.lower(text_or_empty(text)), BORDER), lambda s: s != "")


def phrase_matches(
    df: DataFrame, phrases: DataFrame, prompt: str = "prompt", carry: Sequence[str] = (LABEL,)
) -> DataFrame:
    """Rows × phrases their prompt contains between word borders, in any case; each pair once.

    For keywords of several words, or with signs in them; ``phrases`` has them as ``keyword``. Such a
    phrase is a number of whole segments, so a row emits its distinct runs of as many segments as some
    phrase has, and an equi-join finds the phrases among them: no pattern is matched per phrase. The
    numbers of segments are read when this is called. A phrase without a word character is not looked for.
    """
    cut = phrases.select("keyword").distinct().withColumn("__parts", segments("keyword"))
    cut = settle(cut.filter(F.col("keyword").rlike(r"(?U)\w")))
    sizes = sorted(r[0] for r in cut.select(F.size("__parts")).distinct().collect())
    if not sizes:
        return df.select(*carry, F.lit("").alias("keyword")).limit(0)
    word = r"(?U)^\w"

    def runs(v: Column) -> Column:
        parts = v["parts"]

        def of_size(size: int) -> Column:
            places = F.sequence(F.lit(1), F.size(parts) - size + 1)
            # a border in front of signs needs a word before them, one behind signs a word after them
            inside = F.filter(
                F.when(F.size(parts) >= size, places).otherwise(F.array().cast("array<int>")),
                lambda i: ((i > 1) | F.get(parts, i - 1).rlike(word))
                & ((i + size - 1 < F.size(parts)) | F.get(parts, i + size - 2).rlike(word)),
            )
            return F.transform(inside, lambda i: F.array_join(F.slice(parts, i, size), ""))

        return F.array_distinct(F.concat(*[of_size(size) for size in sizes]))

    found = df.select(*carry, F.explode_outer(bound({"parts": segments(prompt)}, runs)).alias("__run"))
    keyed = cut.select("keyword", F.array_join("__parts", "").alias("__run"))
    return found.join(keyed, "__run").select(*carry, "keyword")


def rate_by_phrase(
    df: DataFrame, phrases: DataFrame, prompt: str = "prompt", label: str = LABEL
) -> DataFrame:
    """Rate among the prompts that contain each phrase; phrases without a prompt are left out."""
    hits = phrase_matches(df, phrases, prompt, [label])
    return hits.groupBy("keyword").agg(
        share(flag_of(df, label)).alias("hallucination_rate"), F.count(F.lit(1)).alias("n")
    )


def rate_by_keyword(
    df: DataFrame,
    top_n: int = 10,
    prompt: str = "prompt",
    label: str = LABEL,
    stop_words: Sequence[str] = KEYWORD_STOPWORDS,
) -> DataFrame:
    """Rate among the prompts that contain each top keyword; empty if nothing is positive.

    The keywords, top_n rows, are settled when this is called.
    """
    top = settle(tfidf_keywords(df, top_n, prompt, label, stop_words))
    hits = keyword_matches(df, top, prompt, [label])
    rates = hits.groupBy("keyword").agg(
        share(flag_of(df, label)).alias("hallucination_rate"), F.count(F.lit(1)).alias("n")
    )
    ranked = rates.join(top, "keyword")
    return ranked.orderBy(F.desc(F.round("weight", 12)), F.asc("keyword"))
