"""Passages of benchmark items in training texts.

The items are an inverted index with BM25 impacts; every passage of every text is a query. A score is
stated as a share of what the item scores against itself, so one threshold fits items of any length
and the search can skip by it: postings are cut into blocks of items with the largest impact of each
block, and a passage visits only blocks whose bound reaches the threshold (block-max WAND with a fixed
threshold instead of a growing k-th score, hence nothing above it is missed). The most frequent words
add to a bound what they can add at most in any item of the block, so only the postings of the other
words are read to find the blocks. Every passage found is verified on the words, the best one first:
five-word overlap with the question and with the answer.

The index is broadcast in blocks of about ``BLOCK_WORDS`` words of items, one pass over the texts for
each, and a block goes before the next one comes. Document frequencies and lengths are those of all
items, so a score does not depend on the block. Texts are neither shuffled nor collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.session import discard, written

PASSAGE, STRIDE = 64, 16  # words of a passage, words to the next
SEGMENT = PASSAGE - STRIDE  # longer items are indexed in pieces, each lies whole in some passage
MIN_SHARE = 0.5  # of the item's score against itself
QUESTION, PARTLY, ANSWER = 0.8, 0.5, 0.5
GRAM = 5
K1, B = 1.2, 0.75
BLOCK = 4
COMMON_SHARE = 0.6  # of the threshold that frequent words may make up in an item
MOST_CELLS = 4_000_000  # passages times blocks whose bounds are held at once
BLOCK_WORDS = 1_000_000  # words of items in one broadcast index, about 40 MB

HIT = "array<struct<item_id: string, start: int, end: int, score: double, question: double, answer: double>>"


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text: what follows an "Answer:" or "A:" mark, else
    the last line if there are several, else the last sentence. One sentence is all question."""
    marked = re.split(r"(?:^|\n)\s*(?:answer|a)\s*:\s*", text, maxsplit=1, flags=re.I)
    if len(marked) == 2 and marked[0].strip():
        return marked[0], marked[1]
    for cut in (r"\n+", r"(?<=[.?!])\s+"):
        parts = re.split(f"({cut})", text.strip())
        if len(parts) > 2 and common.TOKEN.search(parts[-1]):
            return "".join(parts[:-2]), parts[-1]
    return text, ""


def _grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return set(zip(*(words[i:] for i in range(n)))) if words else set()


def overlaps(question: set, answer: set, of_question: set, of_answer: set) -> tuple[float, float]:
    """Shares of the runs of question and answer that are among those given."""
    return (
        len(question & of_question) / len(question) if question else 0.0,
        len(answer & of_answer) / len(answer) if answer else 0.0,
    )


def verified(q: set, a: set, question: float, answer: float) -> bool:
    return question >= QUESTION or (not q and answer >= QUESTION) or (question >= PARTLY and answer >= ANSWER)


def segments_of(words: list[str]) -> list[list[str]]:
    """An item's words in pieces that each lie whole in some passage."""
    pieces = max(1, -(-len(words) // SEGMENT))
    size = -(-len(words) // pieces)
    return [words[i : i + size] for i in range(0, len(words), size)]


class Statistics(NamedTuple):
    """Of all items: number of segments, their mean length, and in how many each word is."""

    segments: int
    mean: float
    df: dict[str, int]


class Index:
    """BM25 impacts of item segments, as shares of the segment's own score, in blocks.

    ``of_all``: the statistics, if the items are only some; ``df`` then has the words of these."""

    def __init__(self, items: list[tuple[str, str, str]], least: float = MIN_SHARE, of_all: Statistics | None = None):
        self.least = least
        self.items = []
        segments: list[tuple[int, list[str]]] = []
        for item_id, question, answer in items:
            q = common.TOKEN.findall((question or "").lower())
            a = common.TOKEN.findall((answer or "").lower())
            words = q + a
            if not words:
                continue
            self.items.append((item_id, _grams(q), min(GRAM, len(q)), _grams(a), min(GRAM, len(a)), len(words)))
            segments += [(len(self.items) - 1, part) for part in segments_of(words)]
        bags = [Counter(words) for _, words in segments]
        df = Counter(t for bag in bags for t in bag)
        self.terms = {t: i for i, t in enumerate(df)}
        mean = sum(len(w) for _, w in segments) / max(1, len(segments))
        of_all = of_all or Statistics(len(bags), mean, df)
        mean, many = of_all.mean, np.array([of_all.df[t] for t in df], float)
        idf = np.log(1 + (of_all.segments - many + 0.5) / (many + 0.5))
        self.blocks = max(1, -(-len(bags) // BLOCK))
        self.owner = np.array([o for o, _ in segments], int)
        lists: list[list[tuple[int, float]]] = [[] for _ in df]
        for n, bag in enumerate(bags):
            length = sum(bag.values())
            impact = {
                t: idf[self.terms[t]] * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in bag.items()
            }
            own = sum(impact.values())
            for t, x in impact.items():
                lists[self.terms[t]].append((n, x / own))
        self._split(lists, len(bags), least)
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        first, block, bound = [0], [], []
        for t, pairs in enumerate(lists):
            by_block: dict[int, list] = {}
            for n, x in pairs:
                by_block.setdefault(n // BLOCK, []).append((n % BLOCK, x))
            for b, held in by_block.items():
                where, x = np.array([h[0] for h in held]), np.array([h[1] for h in held])
                self.postings[t, b] = (where, x)
                if self.rare[t]:
                    block.append(b)
                    bound.append(x.max())
            first.append(len(block))
        self.first, self.block, self.bound = np.array(first), np.array(block, int), np.array(bound)

    def _split(self, lists: list, segments: int, least: float) -> None:
        """Frequent words, and the most they add up to in an item of each block."""
        mass = np.zeros(segments)
        self.rare = np.ones(len(lists) + 1, bool)
        self.rare[-1] = False  # words that no item has
        for t in sorted(range(len(lists)), key=lambda t: (-len(lists[t]), t)):
            where = [n for n, _ in lists[t]]
            added = mass[where] + [x for _, x in lists[t]]
            if added.max() > COMMON_SHARE * least:
                break
            mass[where] = added
            self.rare[t] = False
        padded = np.zeros(self.blocks * BLOCK)
        padded[:segments] = mass
        self.common = padded.reshape(self.blocks, BLOCK).max(axis=1)

    def _blocks(self, ids: np.ndarray, passages: int) -> Iterator[tuple[int, int]]:
        """(passage, block) whose bound reaches the threshold; a word counts once in a passage."""
        at = np.flatnonzero(self.rare[ids])
        term = ids[at]
        order = np.argsort(term, kind="stable")
        earlier = np.full(len(at), -1)
        again = np.flatnonzero(term[order][1:] == term[order][:-1]) + 1
        earlier[order[again]] = at[order[again - 1]]
        step = max(1, MOST_CELLS // self.blocks)
        for low in range(0, passages, step):
            high = min(passages, low + step)
            which, terms = [], []
            for back in range(PASSAGE // STRIDE):
                p = at // STRIDE - back
                ok = (p >= low) & (p < high) & (earlier < p * STRIDE)
                which.append(p[ok] - low)
                terms.append(term[ok])
            p, t = np.concatenate(which), np.concatenate(terms)
            many = self.first[t + 1] - self.first[t]
            shift = np.repeat(self.first[t] - (np.cumsum(many) - many), many)
            row = np.arange(len(shift)) + shift
            cell = np.repeat(p, many) * self.blocks + self.block[row]
            bound = np.bincount(cell, self.bound[row], minlength=(high - low) * self.blocks)
            bound = bound.reshape(high - low, self.blocks) + self.common
            for p, b in zip(*np.nonzero(bound >= self.least - 1e-9)):
                yield low + int(p), int(b)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, segment, score) of every score that reaches the threshold. ``ids`` are the words
        of a text, -1 for those that no item has."""
        passages = max(1, -(-(len(ids) - PASSAGE) // STRIDE) + 1)
        last, distinct = -1, np.empty(0)
        for p, b in self._blocks(ids, passages):
            if p != last:
                part = ids[p * STRIDE : p * STRIDE + PASSAGE]
                last, distinct = p, np.unique(part[part >= 0]).tolist()
            acc = np.zeros(BLOCK)
            for t in distinct:
                part = self.postings.get((t, b))
                if part is not None:
                    acc[part[0]] += part[1]
            for s in np.flatnonzero(acc >= self.least - 1e-9):
                yield p, b * BLOCK + int(s), float(acc[s])

    def hits(self, text: str) -> list[tuple]:
        """(item, first code point, end, score, question overlap, answer overlap) of each verified
        item, at its best passage that verifies; the span is that of the passage."""
        low = text.lower()
        words = common.TOKEN.findall(low)
        if not words or not self.items:
            return []
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        found: dict[int, dict[int, float]] = {}  # item -> passage -> score of its best segment
        for p, segment, score in self.search(ids):
            scores = found.setdefault(int(self.owner[segment]), {})
            scores[p] = max(score, scores.get(p, 0.0))
        out = []
        whole: dict[int, set] = {}  # runs of words of the whole text, by their length
        for owner, scores in sorted(found.items()):
            item_id, q, qn, a, an, length = self.items[owner]
            for n in (qn, an):
                if n not in whole:
                    whole[n] = _grams(words, n)
            # what the whole text lacks, no passage has
            if not verified(q, a, *overlaps(q, a, whole[qn], whole[an])):
                continue
            for p in sorted(scores, key=lambda p: (-scores[p], p)):
                s, e = p * STRIDE, min(len(words), p * STRIDE + PASSAGE)
                near = words[max(0, s - length) : e + length]
                question, answer = overlaps(q, a, _grams(near, qn), _grams(near, an))
                if verified(q, a, question, answer):
                    out.append((item_id, s, e, scores[p], question, answer))
                    break
        if not out:
            return []
        # lower case may change the number of characters of rare letters; spans are of the text itself
        source = low if len(low) == len(text) else text
        spans = [m.span() for m in common.TOKEN.finditer(source)]
        if len(spans) != len(words):
            return [(i, 0, len(text), *rest) for i, _, _, *rest in out]
        return [(i, spans[s][0], spans[e - 1][1], *rest) for i, s, e, *rest in out]


def index_blocks(items: DataFrame, least: float) -> tuple[int, Iterator[Index]]:
    """Number of indexes over items (item_id, question, answer), each of bounded size, and the indexes.

    Items are dealt to blocks by a hash of the id; a block is fetched when its turn comes.
    """
    told = items.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
    )
    size = F.length("question") + F.length("answer")
    chars = told.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(chars) // (5 * BLOCK_WORDS)))
    return blocks, _indexes(told, blocks, least)


def _indexes(told: DataFrame, blocks: int, least: float) -> Iterator[Index]:
    if blocks == 1:
        yield Index(sorted(tuple(r) for r in told.collect()), least)
        return

    @F.pandas_udf("struct<segments: long, words: long, terms: array<struct<term: string, n: long>>>")
    def counted(question: pd.Series, answer: pd.Series) -> pd.DataFrame:
        rows = []
        for q, a in zip(question, answer):
            words = common.TOKEN.findall(q.lower()) + common.TOKEN.findall(a.lower())
            parts = segments_of(words) if words else []
            rows.append((len(parts), len(words), list(Counter(t for part in parts for t in set(part)).items())))
        return pd.DataFrame(rows, columns=["segments", "words", "terms"])

    told = told.withColumn("block", F.pmod(F.xxhash64("item_id", "question"), F.lit(blocks)))
    counts = written(told.select("block", counted("question", "answer").alias("s")).select("block", "s.*"), "item-counts")
    total = counts.agg(F.sum("segments").alias("segments"), F.sum("words").alias("words")).first()
    terms = counts.select("block", F.explode("terms").alias("t")).select("block", "t.*")
    terms = terms.groupBy("block", "term").agg(F.sum("n").alias("n"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    terms = written(terms.select("block", "term").join(df, "term"), "item-terms")
    mean = total["words"] / max(1, total["segments"])
    for b in range(blocks):
        # the items of one block and their words
        here = terms.filter(F.col("block") == b).select("term", "df").collect()
        part = told.filter(F.col("block") == b).drop("block").collect()
        yield Index(sorted(tuple(r) for r in part), least, Statistics(total["segments"], mean, dict(map(tuple, here))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, question, answer of a table (item_id, text). Missing texts are empty items, which
    match nothing."""

    @F.pandas_udf("struct<question: string, answer: string>")
    def halves(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_item(t) for t in common.texts_of(text)], columns=["question", "answer"])

    return benchmark.select("item_id", halves("text").alias("__h")).select("item_id", "__h.question", "__h.answer")


def searcher(shared):
    """A column function: text → verified matches in one index; empty for a missing or empty text and
    for an empty benchmark."""

    @F.pandas_udf(HIT)
    def search(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.hits(t) for t in common.texts_of(text)], dtype=object)

    return search


def contaminated(docs: DataFrame, items: DataFrame, least: float = MIN_SHARE) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start and end (code points of the
    passage), score, question and answer (overlaps). Repeated rows of documents report each.

    With several blocks of items the call makes a pass over the texts for each."""
    blocks, indexes = index_blocks(items, least)
    found = None
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        hits = docs.select("doc_id", F.explode(searcher(shared)("text")).alias("m")).select("doc_id", "m.*")
        if blocks > 1:
            hits = written(hits, "matches")
            shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = MIN_SHARE) -> DataFrame:
    """The rows without a verified match, with the columns of ``docs``.

    With several blocks of items the call makes a pass for each over what the ones before left."""
    blocks, indexes = index_blocks(items, least)
    clean = docs
    for number, index in enumerate(indexes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        left = clean.filter(F.size(searcher(shared)("text")) == 0)
        if blocks > 1:
            left = written(left, "without-matches")
            shared.destroy()
            if number:
                discard(clean)
        clean = left
    return clean
