"""Languages of a text as a mixture, by expectation-maximisation.

A text is cut into units of a few words. Each unit has a likelihood under each language, from
character n-grams; EM estimates the proportions in which languages produced the units. The set of
languages is chosen by penalised likelihood (BIC): the weakest language is left out as long as that
costs less than half the logarithm of the number of units.

Models are counts of hashed n-grams of all training texts, added up by Spark. Their size is fixed by
``BUCKETS`` and the number of languages, so they can be broadcast. Texts are scored in one pass
without a shuffle, many at a time in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common

BUCKETS = 1 << 16
SIZES = (2, 3)
UNIT_WORDS = 6
ROUNDS = 25
SMOOTH = 0.5
MAX_LANGUAGES = 400  # learned languages; more raise an error, the model is broadcast
PIECE = 500_000  # code points worked on at once

PREDICTION = "struct<lang_pred: string, score: double, mixture: map<string, double>>"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _is_letter() -> np.ndarray:
    """Letters and marks of all code points; built once per worker."""
    import sys
    import unicodedata

    table = np.zeros(sys.maxunicode + 1, bool)
    for c in range(len(table)):
        table[c] = unicodedata.category(chr(c))[0] in "LM"
    return table


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(_is_letter())
    return _letters[0]


def normal(text: str) -> np.ndarray:
    """Lower-case code points; every stretch without letters is one blank, also at both ends."""
    codes = _codes(text.lower())
    keep = letters()[codes]
    out = np.where(keep, codes, np.uint32(32))
    gap = ~keep
    out = out[~(gap & np.concatenate([[True], gap[:-1]]))]  # first of a stretch after a letter stays
    if not len(out):
        return out
    if out[-1] != 32:
        out = np.append(out, np.uint32(32))
    return np.concatenate([np.array([32], np.uint32), out])


def ngrams(codes: np.ndarray) -> list[np.ndarray]:
    """For each size, the bucket of the n-gram that ends at each position (from size - 1 on)."""
    wide = codes.astype(np.uint64)
    out = []
    for n in SIZES:
        h = np.zeros(max(0, len(wide) - n + 1), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B1) + wide[i : i + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64))
    return out


def pieces(codes: np.ndarray, size: int = PIECE):
    """A long text in pieces that end between words."""
    start = 0
    while start < len(codes):
        end = min(len(codes), start + size)
        if end < len(codes):
            blank = np.flatnonzero(codes[start:end] == 32)
            if len(blank) and blank[-1] > 0:
                end = start + int(blank[-1])
        yield codes[start : min(len(codes), end + 1)]
        start = end if end < len(codes) - 1 else len(codes)


class Model:
    def __init__(self, languages: list[str], counts: list[np.ndarray]):
        """``counts``: for each size, a (BUCKETS, languages) table."""
        self.languages = languages
        self.logs = []
        for table in counts:
            smooth = table + SMOOTH
            self.logs.append(np.log(smooth / smooth.sum(axis=0)).astype(np.float32))

    def units(self, text: str) -> np.ndarray:
        """Log-likelihood of each unit under each language; no rows without letters."""
        found = []
        for codes in pieces(normal(text)):
            if len(codes) < 3:
                continue
            # every n-gram belongs to the unit in which it ends
            word = np.cumsum(codes == 32) - 1
            unit = np.maximum(word - (codes == 32), 0) // UNIT_WORDS
            total = np.zeros((int(unit[-1]) + 1, len(self.languages)))
            for n, buckets, logs in zip(SIZES, ngrams(codes), self.logs):
                if len(buckets):
                    ends = unit[n - 1 :]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(ends) > 0]))
                    total[ends[first]] += np.add.reduceat(logs[buckets].astype(float), first, axis=0)
            found.append(total / len(SIZES))
        return np.concatenate(found) if found else np.empty((0, len(self.languages)))


def mixtures(units: list[np.ndarray]) -> list[np.ndarray]:
    """Proportions of the languages in each of several texts, all worked on together."""
    n = np.array([len(u) for u in units])
    filled = np.flatnonzero(n)
    out = [np.zeros(u.shape[1]) for u in units]
    if not len(filled):
        return out
    every = np.concatenate([units[i] for i in filled])
    top = every.max(axis=1, keepdims=True)
    like = np.exp(every - top)
    size = n[filled]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(filled)), size)
    base = np.add.reduceat(top[:, 0], starts)

    def em(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(ROUNDS):
            share = weights[owner] * like
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            weights = np.add.reduceat(share, starts, axis=0) / size[:, None]
        fit = np.log(np.maximum((weights[owner] * like).sum(axis=1), 1e-300))
        return weights, base + np.add.reduceat(fit, starts)

    best, fit = em(np.full((len(filled), every.shape[1]), 1.0 / every.shape[1]))
    price = 0.5 * np.log(size + 1.0)
    open_ = np.ones(len(filled), bool)
    # drop the weakest language of each text as long as the penalised likelihood gains
    for _ in range(every.shape[1] - 1):
        trial = best.copy()
        held = np.where(best > 0, best, np.inf)
        weak = held.argmin(axis=1)
        can = open_ & ((best > 0).sum(axis=1) > 1)
        if not can.any():
            break
        rows = np.flatnonzero(can)
        trial[rows, weak[rows]] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        new, new_fit = em(trial)
        gain = can & (new_fit + price >= fit)
        best[gain], fit[gain] = new[gain], new_fit[gain]
        open_ &= gain
    for i, row in zip(filled, best):
        out[i] = row
    return out


def train(docs: DataFrame, learn: Column) -> Model:
    """Counts of n-grams by language over all rows that ``learn`` selects (doc_id, text, lang)."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                for codes in pieces(normal(text)):
                    for s, buckets in enumerate(ngrams(codes)):
                        at = total.setdefault((number[lang], s), np.zeros(BUCKETS, np.int64))
                        at += np.bincount(buckets, minlength=BUCKETS)
        for (lang, s), table in total.items():
            some = np.flatnonzero(table)
            yield pd.DataFrame({"l": lang, "s": s, "b": some, "n": table[some]})

    counted = rows.mapInPandas(count, "l int, s int, b int, n long").groupBy("l", "s", "b").agg(F.sum("n").alias("n"))
    # at most languages x sizes x BUCKETS rows of four numbers
    told = counted.toPandas()
    tables = [np.zeros((BUCKETS, max(1, len(languages)))) for _ in SIZES]
    for s in range(len(SIZES)):
        part = told[told["s"] == s]
        tables[s][part["b"], part["l"]] = part["n"]
    return Model(languages, tables)


def detector(docs: DataFrame, model: Model):
    """A column function: text → struct of lang_pred, score (its proportion), mixture.

    ``und`` with score 0 for missing texts, texts without a letter, and without learned languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def detect(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        texts = common.texts_of(text)
        found: list[np.ndarray] = []
        held: list[np.ndarray] = []
        rows = 0
        for t in texts:
            held.append(m.units(t) if m.languages else np.empty((0, 1)))
            rows += len(held[-1])
            if rows > 100_000:
                found += mixtures(held)
                held, rows = [], 0
        found += mixtures(held)
        lang, score, mixture = [], [], []
        for t, weights in zip(texts, found):
            best = int(weights.argmax())
            # marks count inside words, but alone they are no letters
            known = weights[best] > 0 and any(map(str.isalpha, t))
            lang.append(m.languages[best] if known else "und")
            score.append(float(min(1.0, weights[best])) if known else 0.0)
            mixture.append({m.languages[i]: float(w) for i, w in enumerate(weights) if w > 0})
        return pd.DataFrame({"lang_pred": lang, "score": score, "mixture": mixture})

    return detect


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """All columns of ``docs`` and a struct ``language`` (renamed if taken)."""
    model = train(docs, learn)
    return docs.withColumn(common.free_name(docs, "language"), detector(docs, model)(F.col("text")))
