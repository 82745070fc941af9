"""Toxicity scores from the nearest labelled examples.

Exact cosine between TF-IDF vectors over whole texts and their whole vocabulary (words cut to their
first ``STEM`` letters), found through an inverted index: the postings of a term are cut by blocks of
examples, with the largest weight of each block kept beside them. The nearest examples, toxic or not, vote with their squared similarity; the
vote is calibrated on labelled rows that are not in the index.

The weight of a term is (1 + ln tf) * idf * rf. The relevance frequency rf = log2(2 + a / max(1, c))
compares the toxic rows a with the clean rows c (brought to the same number of rows) that hold the
term. It is 1 or more for every term, so none is cut, and texts that share all words have cosine 1
whatever their words are. Without it a few insults weigh nothing against hundreds of common words.

What is fitted is a classifier on a bounded sample of labelled rows (``FIT_ROWS`` of each class,
the smallest hashes of the id): document frequencies, examples and calibration. The index holds the
words of at most ``EXAMPLES`` texts of each class as 64-bit hashes, and is the only thing that passes
through the driver. Every text is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.session import discard, written

FIT_ROWS = 12_000  # labelled rows of each class that the classifier is fitted on
EXAMPLES = 1_024  # of these, rows of each class that are indexed; at most three quarters of a class
STEM = 6  # letters of a word that count, so that inflected and compound words share a term
NEIGHBOURS = 25
BLOCK = 64
VISIT = 8  # blocks that are looked at first
CALIBRATION_BINS = 200
ACCEPT = 0.7

SCORE = "score double, predicted int, neighbours int, evidence string"

_word_hash = functools.lru_cache(200_000)(xxhash.xxh64_intdigest)


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct stems of a text, rising, and how often each occurs."""
    counts = Counter(word[:STEM] for word in common.TOKEN.findall(text.lower()))
    terms = np.fromiter(map(_word_hash, counts), np.uint64, len(counts))
    order = np.argsort(terms)
    return terms[order], np.fromiter(counts.values(), float, len(counts))[order]


def term_weight(n: np.ndarray, bad: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """idf * rf of terms that ``n`` rows hold, ``bad`` of them toxic, out of ``rows`` and ``toxic``."""
    idf = np.log((rows + 1) / (n + 1)) + 1e-3
    return idf * np.log2(2 + bad / np.maximum(1, (n - bad) * toxic / max(1, rows - toxic)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), then the same of the next."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


@dataclass
class Index:
    """Example vectors, inverted.

    Term i (hash ``terms[i]``, rising) has the entries ``first[i]`` to ``first[i + 1]``, one for each
    block of examples that holds it. Entry e tells the ``block``, the largest weight ``most`` in it
    and its postings ``at[e]`` to ``at[e + 1]``: examples ``who`` and their ``weight``.
    """

    terms: np.ndarray
    scale: np.ndarray
    unseen: float
    labels: np.ndarray
    ids: list
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    at: np.ndarray
    who: np.ndarray
    weight: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = field(default=(np.zeros(1), np.zeros(1)))

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a vector of length 1. Terms that no example has are weighted as
        if no row had them; they count in the length."""
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        weight = (1 + np.log(tf)) * (np.where(known, self.scale[at], self.unseen) if len(self.terms) else self.unseen)
        weight /= np.sqrt((weight**2).sum())
        return at[known], weight[known]

    def nearest(self, ids: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k largest cosines and their examples, ties by example number.

        The blocks with the largest upper bounds are visited first. Of the others, those whose bound is
        below the k-th best cosine of these cannot hold a neighbour; the rest is visited together.
        """
        best, who = np.empty(0), np.empty(0, np.int64)
        size = self.first[ids + 1] - self.first[ids]
        entry, w = _ranges(self.first[ids], size), np.repeat(weight, size)
        if not len(entry):
            return best, who
        block = self.block[entry]
        blocks = -(-len(self.ids) // BLOCK)
        bound = np.bincount(block, w * self.most[entry], blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        for group in (order[:VISIT], order[VISIT:]):
            if len(best) == k:  # a margin for rounding: sums may be taken in another order
                group = group[bound[group] >= best[-1] - 1e-9]
            if not len(group):
                break
            seen = np.zeros(blocks, bool)
            seen[group] = True
            chosen = np.flatnonzero(seen[block])
            start = self.at[entry[chosen]]
            long = self.at[entry[chosen] + 1] - start
            posting = _ranges(start, long)
            cosine = np.bincount(self.who[posting], np.repeat(w[chosen], long) * self.weight[posting], len(self.ids))
            hit = np.flatnonzero(cosine >= best[-1]) if len(best) == k else np.flatnonzero(cosine)
            best, who = np.concatenate([best, cosine[hit]]), np.concatenate([who, hit])
            top = np.lexsort((who, -best))[:k]
            best, who = best[top], who[top]
        return best, who

    def vote(self, text: str, k: int = NEIGHBOURS) -> tuple[float, int, str]:
        """Uncalibrated vote, number of neighbours, and the three nearest as evidence."""
        best, who = self.nearest(*self.vector(*terms_of(text)), k)
        if not len(best):
            return 0.0, 0, ""
        strength = best**2
        raw = float((strength * self.labels[who]).sum() / strength.sum())
        shown = " ".join(f"{self.ids[w]}:{int(self.labels[w])}:{s:.3f}" for s, w in zip(best[:3], who[:3]))
        return raw, len(best), shown

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def build(examples: list[tuple], known: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, toxic: int) -> Index:
    """``examples``: (id, label, term hashes, counts), a bounded list. ``known``: the hashes of all terms
    of the examples, rising, the rows that hold each, and the toxic rows that do."""
    terms, n, bad = known
    none = np.zeros(0, np.int64)
    unseen = float(term_weight(np.zeros(1), np.zeros(1), rows, toxic)[0])
    index = Index(terms, term_weight(n, bad, rows, toxic), unseen, np.empty(0), [], none, none, np.empty(0), none, none, np.empty(0))
    vectors = [(i, y, *index.vector(t, c), c) for i, y, t, c in examples if len(t)]

    def kin(v: tuple) -> tuple:
        # like with like, so that the bounds of a block are tight: by the commonest word, which tells
        # the language, then by the heaviest of the words that others have as well
        _, _, ids, weight, tf = v
        shared = np.where(n[ids] > 1, weight, 0)
        return int(ids[np.argmax(tf * (n[ids] > rows / 50))]), v[1], int(ids[np.argmax(shared)]), str(v[0])

    vectors.sort(key=kin)
    index.labels = np.array([v[1] for v in vectors], float)
    index.ids = [v[0] for v in vectors]
    if not vectors:
        index.first = np.zeros(len(terms) + 1, np.int64)
        return index
    term = np.concatenate([v[2] for v in vectors])
    who = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[2]) for v in vectors])
    weight = np.concatenate([v[3] for v in vectors])
    order = np.lexsort((who, term))
    term, who, weight = term[order], who[order].astype(np.int64), weight[order]
    block = who // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)]))
    index.first = np.searchsorted(term[new], np.arange(len(terms) + 1))
    index.block, index.most = block[new], np.maximum.reduceat(weight, new)
    index.at, index.who, index.weight = np.append(new, len(term)), who, weight
    return index


def monotone(raw: np.ndarray, label: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising step-free curve from votes to shares of label 1 (pool adjacent violators)."""
    bins = np.minimum((raw * CALIBRATION_BINS).astype(int), CALIBRATION_BINS)
    pools: list[list[float]] = []  # sum of votes, rows, toxic rows
    for b in np.unique(bins):
        m = bins == b
        pools.append([raw[m].sum(), m.sum(), label[m].sum()])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    x = np.array([p[0] / p[1] for p in pools])
    y = np.array([(p[2] + prior) / (p[1] + 1) for p in pools])
    y = np.maximum.accumulate(y)
    # strictly rising, so that a stronger vote never ties with a weaker one
    x, y = np.concatenate([[0.0], x, [1.0]]), np.concatenate([[y[0] * 0.5], y, [max(y[-1], 0.5)]])
    keep = np.concatenate([[True], np.diff(x) > 0])
    return x[keep], 0.999 * np.maximum.accumulate(y[keep]) + 0.001 * x[keep]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Index:
    """Fit on labelled rows.

    ``docs``: doc_id, text. ``labels``: doc_id, toxic (0, 1 or NULL, which is skipped). ``learn``: a
    condition on ``labels`` that names the rows to learn from. Without rows of both classes the index
    is empty and every score is the share of label 1, or 0.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    parts = [
        known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(FIT_ROWS) for y in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y"))
    # at most 2 * FIT_ROWS short rows
    fitted = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", "__y", "text")
    # copies of one text must not make its rare words look telling
    distinct = fitted.groupBy(common.text_key(F.col("text")).alias("k")).agg(
        F.min("__id").alias("__id"), F.max("__y").alias("__y"), F.first("text").alias("text")
    )
    distinct = written(distinct, "toxicity-fit").select("__id", "__y", "text")
    sizes = {r["__y"]: r["n"] for r in distinct.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    toxic, rows = sizes.get(1, 0), sum(sizes.values())
    nothing = np.empty(0)
    if not toxic or toxic == rows:
        empty = build([], (np.empty(0, np.uint64), nothing, nothing), max(1, rows), toxic)
        share = toxic / rows if rows else 0.0
        empty.knots = (np.array([0.0, 1.0]), np.array([share, share]))
        return empty
    # the others of a class are kept out of the index, for the calibration
    by_hash = F.xxhash64("__id", F.lit("example"))
    taken = [
        distinct.filter(F.col("__y") == y).select("__id").orderBy(by_hash, "__id").limit(min(EXAMPLES, -(-3 * sizes[y] // 4)))
        for y in (0, 1)
    ]
    # at most 2 * EXAMPLES ids
    taken = written(taken[0].unionByName(taken[1]), "toxicity-ids")

    @F.pandas_udf("struct<t: array<long>, c: binary>")
    def split(text: pd.Series) -> pd.DataFrame:
        found = [terms_of(t) for t in common.texts_of(text)]
        return pd.DataFrame({"t": [t.view(np.int64) for t, _ in found], "c": [c.astype("<i4").tobytes() for _, c in found]})

    examples = distinct.join(F.broadcast(taken), "__id").select("__id", "__y", split("text").alias("s"))
    examples = written(examples.select("__id", "__y", "s.t", "s.c"), "toxicity-examples")
    flagged = distinct.join(F.broadcast(taken.withColumn("__in", F.lit(True))), "__id", "left")
    flagged = flagged.select("__y", F.coalesce("__in", F.lit(False)).alias("__in"), "text")

    def partial_counts(batches):
        for batch in batches:
            found = [terms_of(text)[0] for text in common.texts_of(batch["text"])]
            size = [len(t) for t in found]
            terms, where = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_inverse=True)
            bad, inside = (np.bincount(where, np.repeat(batch[c].astype(float), size), len(terms)) for c in ("__y", "__in"))
            columns = {"n": np.bincount(where, minlength=len(terms)), "bad": bad.astype(np.int64), "inside": inside.astype(np.int64)}
            yield pd.DataFrame({"term": terms.view(np.int64), **columns})

    # terms that no example has are not kept
    stats = (
        flagged.mapInPandas(partial_counts, "term long, n long, bad long, inside long")
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("n", "bad", "inside")])
        .filter("inside > 0")
    )
    # packed, so that the driver gets bytes: 24 for each term of the examples
    packed = stats.mapInPandas(_packed, "terms binary, n binary, bad binary").collect()
    columns = [np.frombuffer(b"".join(r[c] for r in packed), "<i8") for c in ("terms", "n", "bad")]
    terms = columns[0].view(np.uint64)
    rising = np.argsort(terms)
    rare = (terms[rising], columns[1][rising].astype(float), columns[2][rising].astype(float))
    del packed, columns, terms
    bounded = [
        (i, y, np.frombuffer(t, "<i8").view(np.uint64), np.frombuffer(c, "<i4").astype(float))
        for i, y, t, c in examples.mapInPandas(_as_bytes, "id string, y int, t binary, c binary").collect()
    ]
    index = build(sorted(bounded, key=lambda e: e[0]), rare, rows, toxic)
    del bounded
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("double")
    def votes(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.vote(t)[0] for t in common.texts_of(text)], dtype=float)

    rest = distinct.join(F.broadcast(taken), "__id", "left_anti")
    told = rest.select("__y", votes("text").alias("v")).collect()  # two numbers for each fitted row
    shared.unpersist()
    discard(examples, taken)
    raw, label = np.array([r["v"] for r in told]), np.array([r["__y"] for r in told], float)
    index.knots = monotone(raw, label, toxic / rows)
    return index


def _packed(batches):
    for b in batches:
        yield pd.DataFrame(
            {k: [b[c].to_numpy("<i8").tobytes()] for k, c in (("terms", "term"), ("n", "n"), ("bad", "bad"))}
        )


def _as_bytes(batches):
    for b in batches:
        terms = [np.asarray(t, "<i8").tobytes() for t in b["t"]]
        yield pd.DataFrame({"id": b["__id"].astype(str), "y": b["__y"].astype("int32"), "t": terms, "c": b["c"]})


def scorer(docs: DataFrame, index: Index):
    """A column function: text → struct of score, predicted, neighbours, evidence.

    Evidence lists up to three neighbours as id:label:cosine. Missing and empty texts have no
    neighbours and get the score of an empty vote.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the words of 2 * EXAMPLES texts

    @F.pandas_udf(SCORE)
    def score(text: pd.Series) -> pd.DataFrame:
        ix = shared.value
        votes = [ix.vote(t) for t in common.texts_of(text)]
        value = ix.calibrated(np.array([v[0] for v in votes], float))
        return pd.DataFrame(
            {
                "score": value,
                "predicted": (value >= ACCEPT).astype("int32"),
                "neighbours": np.array([v[1] for v in votes], "int32"),
                "evidence": [v[2] for v in votes],
            }
        )

    return score


def score_documents(docs: DataFrame, index: Index) -> DataFrame:
    """All columns of ``docs`` and a struct ``toxicity`` (renamed if that name is taken)."""
    return docs.withColumn(common.free_name(docs, "toxicity"), scorer(docs, index)(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """The rows not predicted toxic, with the columns of ``docs``. Rows without a text stay unless an
    empty text counts as toxic. Repeated rows are judged alike."""
    index = fit(docs, labels, learn)
    return docs.filter(scorer(docs, index)(F.col("text"))["predicted"] == 0)
