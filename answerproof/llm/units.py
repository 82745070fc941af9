"""Removal of repeated text passages by global hashing.

A passage goes if it has ``min_words`` words in a row that stand earlier, wherever it begins and ends.
Words are normalised (lower case, punctuation and spacing ignored). The unit is every window of
``min_words`` words: a window that occurs earlier is cut, so a run of such windows is a maximal match
with its exact ends, from its first word to its last. The spans cut are reported in the offsets of the
original text; they overlap where two passages from different places do.

Not every window is hashed globally. Each one chooses the smallest hash among its runs of ``GRAM``
words (winnowing), which depends on its own words only; equal windows choose equal anchors. Neighbours
that choose the same anchor are one row, named by all words they cover. Rows whose anchor occurs once
are settled. Among those with equal names all windows but the earliest row's are later copies, and only
anchors found under several names have their windows compared one by one.

Sentences, lines and paragraphs as units are there too: then whole units are compared, and runs of
later ones with enough words are cut. A sentence of a few words is taken together with the next one,
so that chance repeats ("Of course.") are no units of their own.

Hashes meet in an aggregate with partial results and come back by a join with one row per hash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.session import discard, written

MIN_WORDS = 25
GRAM = 8  # words of an anchor
SHORT = 6
ENDS = {
    "sentence": re.compile(r"(?:[.!?]+(?=\s)|\n)\s*"),
    "line": re.compile(r"\n\s*"),
    "paragraph": re.compile(r"\n[ \t]*\n\s*"),
}
UNIT = "array<struct<i: int, start: int, end: int, words: int, h: long, c: int>>"


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


def tokens(text: str, places: bool = False) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words, and their offsets in the text itself if asked for."""
    low = text.lower()
    if len(low) == len(text):
        words = common.TOKEN.findall(low)
    else:
        # lower case changes the number of characters of rare letters
        words, low = [w.lower() for w in common.TOKEN.findall(text)], text
    return words, [m.span() for m in common.TOKEN.finditer(low)] if places else []


class _Digests(dict):
    """128-bit digests of words, remembered as long as there are not too many."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        self[word] = digest = xxhash.xxh3_128_digest(word)
        return digest


DIGESTS = _Digests()


class Rolling:
    """Hash (64 bits) and check (31 bits) of any run of words of a text, by polynomials modulo 2^64."""

    def __init__(self, words: list[str]):
        both = np.frombuffer(b"".join(map(DIGESTS.__getitem__, words)), "<u8").reshape(-1, 2)
        n = len(words)
        power = np.full(n + 1, BASE, np.uint64)
        inverse = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        zero = np.zeros(1, np.uint64)
        self.sums = [np.concatenate([zero, np.cumsum(both[:, i] * power[:n], dtype=np.uint64)]) for i in (0, 1)]

    def _run(self, i: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[i][end] - self.sums[i][start]) * self.inverse[start])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._run(0, start, end)

    def checks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._run(1, start, end) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def windows(roll: Rolling, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and check of the windows of ``size`` words that begin at the words ``start``."""
    return roll.hashes(start, start + size).view(np.int64), roll.checks(start, start + size)


def anchors(text: str, size: int) -> list[tuple[int, int, int, int, int]]:
    """(first window, windows, anchor, hash, check) of each stretch of windows with the same anchor.

    Hash and check are of all words of the stretch and of where the anchor stands in it."""
    words, _ = tokens(text)
    many = len(words) - size + 1
    if many < 1:
        return []
    roll = Rolling(words)
    gram = min(GRAM, size)
    at = np.arange(len(words) - gram + 1)
    grams = roll.hashes(at, at + gram)
    chosen = np.arange(many) + np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    count = np.diff(np.append(first, many))
    end = first + count - 1 + size
    shape = ((chosen[first] - first) * (size + 1) + count).astype(np.uint64)
    name = common.mix(roll.hashes(first, end) ^ common.mix(shape))
    columns = (first, count, grams[chosen[first]].view(np.int64), name.view(np.int64), roll.checks(first, end))
    return list(zip(*(c.tolist() for c in columns)))


def units(text: str, kind: str = "passage", size: int = MIN_WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """(number, start, end, words, hash, check) of the units with a word; offsets in code points.

    Passages are all windows of ``size`` words; a text with fewer words has its sentences instead,
    which do not reach that number together.
    """
    if kind == "passage":
        words, places = tokens(text, True)
        if len(words) < size:
            return units(text, "sentence")
        start = np.arange(len(words) - size + 1)
        h, c = windows(Rolling(words), start, size)
        return [
            (i, places[i][0], places[i + size - 1][1], size, x, y) for i, x, y in zip(start.tolist(), h.tolist(), c.tolist())
        ]
    out = []
    ends = [m.end() for m in ENDS[kind].finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    least = SHORT if kind == "sentence" else 1
    at, pending = 0, []
    start = 0
    for end in ends:
        pending += common.TOKEN.findall(text[at:end].lower())
        at = end
        if len(pending) < least and end != len(text):
            continue
        if pending:
            digest = xxhash.xxh3_128_intdigest(" ".join(pending))
            low = digest & 0xFFFFFFFFFFFFFFFF
            check = (digest >> 64) & 0x7FFFFFFF
            out.append((len(out), start, end, len(pending), low - (1 << 64) if low >> 63 else low, check))
        start, pending = end, []
    return out


def later_units(docs: DataFrame, kind: str, rank: Column) -> DataFrame:
    """d, k, i, start, end, words of every unit that is not the first of its hash.

    First means smallest (rank, id, text key, offset), missing values first.
    """

    @F.pandas_udf(UNIT)
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([units(t, kind) for t in common.texts_of(text)], dtype=object)

    # computed beside explode, the key of the text would be taken anew for every unit; the outer form
    # spares a filter that would cut the text again
    named = docs.select(rank.alias("r"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), cut("text").alias("u"))
    rows = named.select("r", "d", "k", F.explode_outer("u").alias("u")).filter("u is not null").select("r", "d", "k", "u.*")
    place = F.struct("r", "d", "k", "start")
    first = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    # a table of its own: the join can then split a hash that very many documents share
    first = written(first.drop("n"), "first-units")
    return (
        rows.join(first, ["h", "c"])
        .filter(place != F.col("first"))
        .select("d", "k", "i", "start", "end", "words")
    )


def repeated_spans(
    docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, rank: Column | None = None
) -> DataFrame:
    """d, k, spans: per document the runs of later units with at least ``min_words`` words."""
    later = later_units(docs, kind, F.lit(0) if rank is None else rank)
    # one short row per repeated unit of a document; rows equal in id and text are one document
    listed = later.groupBy("d", "k").agg(
        F.sort_array(F.collect_set(F.struct("i", "start", "end", "words"))).alias("u")
    )
    runs = F.aggregate(
        "u",
        F.array().cast("array<struct<i: int, start: int, end: int, words: int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["i"] + 1 == x["i"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        x["i"].alias("i"),
                        F.element_at(acc, -1)["start"].alias("start"),
                        x["end"].alias("end"),
                        (F.element_at(acc, -1)["words"] + x["words"]).alias("words"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    spans = F.transform(
        F.filter(runs, lambda x: x["words"] >= min_words), lambda x: F.struct(x["start"], x["end"])
    )
    return listed.select("d", "k", spans.alias("spans")).filter(F.size("spans") > 0)


def later_windows(docs: DataFrame, size: int, rank: Column) -> DataFrame:
    """d, k, a, n: stretches of n windows of ``size`` words from word number a on that are not the
    first of their hash. They may repeat or overlap each other.

    First means smallest (rank, id, text key, word number), missing values first.
    """

    @F.pandas_udf("array<struct<a: int, n: int, g: long, h: long, c: int>>")
    def stretches(text: pd.Series) -> pd.Series:
        return pd.Series([anchors(t, size) for t in common.texts_of(text)], dtype=object)

    key = [rank.alias("r"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("k")]
    named = docs.select(*key, stretches("text").alias("u"))
    rows = named.select("r", "d", "k", F.explode_outer("u").alias("u")).filter("u is not null").select("r", "d", "k", "u.*")
    # tables of their own: the texts are read once, and joins can split a hash that many documents share
    every = written(rows, "all-anchors")
    again = every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    again = written(again, "repeated-anchors")
    rows = written(every.join(again, "g"), "anchors")
    discard(every, again)
    place = F.struct("r", "d", "k", "a", "n")
    names = rows.groupBy("g", "h", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    names = written(names, "stretches")
    copied = names.filter(F.col("first") != F.col("last")).select("g", "h", "c", "first")
    whole = rows.join(copied, ["g", "h", "c"]).filter(place != F.col("first")).select("d", "k", "a", "n")
    # earliest rows of anchors with several names: their windows may still occur elsewhere
    several = written(names.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g"), "several-names")
    loose = names.join(several, "g").select("first.*")
    loose = loose.groupBy(F.col("r").alias("__r"), F.col("d").alias("__d"), F.col("k").alias("__k")).agg(
        F.collect_list(F.struct("a", "n")).alias("s")
    )

    @F.pandas_udf("array<struct<a: int, h: long, c: int>>")
    def single(text: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
        out = []
        for t, a, n in zip(common.texts_of(text), first, count):
            start = np.unique(np.concatenate([np.arange(x, x + y) for x, y in zip(a, n)]))
            h, c = windows(Rolling(tokens(t)[0]), start, size)
            out.append(list(zip(start.tolist(), h.tolist(), c.tolist())))
        return pd.Series(out, dtype=object)

    texts = docs.select(*key, "text")
    on = common.same(F.col("r"), F.col("__r")) & common.same(F.col("d"), F.col("__d")) & (F.col("k") == F.col("__k"))
    held = texts.join(loose, on).select("r", "d", "k", single("text", "s.a", "s.n").alias("u"))
    ones = held.select("r", "d", "k", F.explode_outer("u").alias("u")).filter("u is not null").select("r", "d", "k", "u.*")
    ones = written(ones, "windows")
    place = F.struct("r", "d", "k", "a")
    first = ones.groupBy("h", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = written(first.filter(F.col("first") != F.col("last")).drop("last"), "first-windows")
    apart = ones.join(first, ["h", "c"]).filter(place != F.col("first")).select("d", "k", "a", F.lit(1).alias("n"))
    return whole.unionByName(apart)


CUT = "text string, removed int, spans array<struct<start: int, end: int>>"


def cut_windows(size: int):
    """A column function: text, first windows, numbers of windows → what is left, and the spans cut."""

    @F.pandas_udf(CUT)
    def cut(text: pd.Series, first: pd.Series, count: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, n in zip(common.texts_of(text), first, count):
            later = np.unique(np.concatenate([np.arange(x, x + y) for x, y in zip(a, n)]))
            _, places = tokens(t, True)
            breaks = np.flatnonzero(np.diff(later) > 1)
            heads, tails = later[np.append(0, breaks + 1)], later[np.append(breaks, len(later) - 1)]
            spans = [(places[x][0], places[y + size - 1][1]) for x, y in zip(heads.tolist(), tails.tolist())]
            at, parts = 0, []
            for start, end in spans:
                parts.append(t[at : max(at, start)])
                at = end
            left = "".join(parts) + t[at:]
            out.append((left, len(t) - len(left), spans))
        return pd.DataFrame(out, columns=["text", "removed", "spans"])

    return cut


def without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for t, a, b in zip(text, starts, ends):
        at, parts = 0, []
        for start, end in zip(np.asarray(a), np.asarray(b)):
            parts.append(t[at:start])
            at = end
        out.append("".join(parts) + t[at:])
    return pd.Series(out, dtype=object)


def dedup_units(
    docs: DataFrame, kind: str = "passage", min_words: int = MIN_WORDS, rank: Column | None = None
) -> DataFrame:
    """The documents that lose something: doc_id, text (what is left), removed (code points),
    spans ("start:end", comma-joined, in offsets of the original text).

    Documents without a row keep their text. ``rank`` orders occurrences before the id does. Missing
    and empty texts have no units; an empty table gives an empty one; rows equal in doc_id and text
    are one document and each get the same row.
    """
    docs = docs.select("doc_id", "text", (F.lit(0) if rank is None else rank).alias("rank"))
    docs = docs.filter(F.col("text").isNotNull())
    on = common.same(F.col("doc_id"), F.col("__d")) & (F.xxhash64("text") == F.col("__k"))
    shown = F.array_join(
        F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ","
    ).alias("spans")
    if kind == "passage":
        found = later_windows(docs, min_words, F.col("rank"))
        found = found.groupBy(F.col("d").alias("__d"), F.col("k").alias("__k")).agg(
            F.collect_set(F.struct("a", "n")).alias("s")
        )
        cut = docs.join(found, on).select("doc_id", cut_windows(min_words)("text", "s.a", "s.n").alias("x"))
        return cut.select("doc_id", "x.*").select("doc_id", "text", "removed", shown)
    spans = repeated_spans(docs, kind, min_words, F.col("rank")).select(
        F.col("d").alias("__d"), F.col("k").alias("__k"), "spans"
    )
    cut = docs.join(spans, on)
    return cut.select(
        "doc_id",
        F.pandas_udf(without, "string")("text", "spans.start", "spans.end").alias("text"),
        F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("removed"),
        shown,
    )
