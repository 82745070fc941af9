"""Ranked lexical search: the highest-scoring documents of every query, exactly.

A score is an inner product of whole numbers: how often the query has a term, times the term's weight
in the document. Documents are projected on the terms of the queries (others add nothing) and cut into
trees of a few thousand. A node of a tree is a ball, the mean of its documents and the distance to the
farthest; no document inside scores more than the query's product with the mean plus its length times
that distance, rounded up. A query opens nodes best bound first and stops at the first bound below the
score it has to reach. At leaves all documents are scored in whole numbers, so rounding decides nothing.

What has to be reached is known from the start: a first round over one in ``SEED_SHARE`` documents gives
each query the k-th best score among these, and no document below it can be among the k best of all.

Queries go in blocks that bound the memory of a task and the size of what is sent to it; each block is
one pass over the texts. Trees are made where the documents are, and only candidates are shuffled.

Defined results: documents or queries that are missing, empty or without a term have no rows and do
not count as documents; texts are taken whole; equal scores are ordered by doc_id, missing ids last;
repeated documents are documents of their own; equal rows of the queries are one query, and an id with
several texts is ranked for each; fewer than k documents with a score above 0 give fewer rows; an empty
table gives none; other columns are never read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.operators.ranking import top_k_per_group
from answerproof.session import written

TOP = 20
#: Queries and distinct terms of a block of queries; a longer query is a block by itself.
BLOCK_QUERIES, BLOCK_TERMS = 256, 16_384
#: Documents and terms of a tree, and documents of a leaf.
TREE_DOCS, TREE_CELLS, LEAF = 8_192, 4_000_000, 64
SEED_SHARE = 64
#: Relative error allowed to sums of products of doubles, far above what rounding can cause.
SLACK = 1e-9
LAST = 1 << 63  # in place of a missing doc_id

#: Bytes that belong to terms stay, A-Z in lower case; all others are a space.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


class Queries(NamedTuple):
    """A block of queries: ids, the number of each term, and term numbers with counts."""

    ids: list
    terms: dict[bytes, int]
    places: list[np.ndarray]
    counts: list[np.ndarray]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries in blocks, read one after the other; a block is what the driver holds at a time."""
    ids, terms, places, counts = [], {}, [], []
    rows = items.select("item_id", "text").distinct().orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        bag = Counter(terms_of(text))
        if not bag:
            continue
        if ids and (len(ids) >= BLOCK_QUERIES or len(terms.keys() | bag.keys()) > BLOCK_TERMS):
            yield Queries(ids, terms, places, counts)
            ids, terms, places, counts = [], {}, [], []
        ids.append(item_id)
        places.append(np.array([terms.setdefault(t, len(terms)) for t in bag], np.int64))
        counts.append(np.array(list(bag.values()), np.int64))
    if ids:
        yield Queries(ids, terms, places, counts)


def projected(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), and the given terms with how often the text has them, for
    documents with any term."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.get
        for batch in batches:
            keep, many, places, counts = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                bag = Counter(map(number, found))
                bag.pop(None, None)
                keep.append(row)
                many.append(len(found))
                places.append(np.fromiter(bag.keys(), "<u4", len(bag)).tobytes())
                counts.append(np.fromiter(bag.values(), "<u4", len(bag)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(keep, pa.int64())),
                    pa.array(many, pa.int64()),
                    pa.array(places, pa.binary()),
                    pa.array(counts, pa.binary()),
                ],
                ["doc_id", "n", "places", "counts"],
            )

    common.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        project, "doc_id long, n long, places binary, counts binary"
    )


def _document_frequencies(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of a block's terms is; partial counts are made where the rows are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            held = b"".join(x.as_py() for x in batch.column("places"))
            seen += np.bincount(np.frombuffer(held, "<u4"), minlength=size)
        term = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(seen[term])], ["term", "n"])

    total = table.select("places").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for term, n in total.collect():
        out[term] = n
    return out


class Corpus(NamedTuple):
    """Documents with a term, and their terms with repeats."""

    documents: int
    terms: int


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(n: int, counts: np.ndarray, weights: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What each term of a document adds to a score for each time the query has it."""
    m = 100 - 25 + (25 * n * corpus.documents) // corpus.terms
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))


class Tree:
    """Balls over sparse documents of whole numbers, in the order of the leaves."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray], width: int):
        self.first = np.append(0, np.cumsum([len(p) for p in places]))
        self.place, self.value = np.concatenate(places), np.concatenate(values)
        self.width = width
        size = self.value.astype(float)
        self.norm = np.add.reduceat(size * size, self.first[:-1])
        order = np.arange(len(places))
        self.means: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        work = [(0, len(order), -1, 0)]
        while work:
            low, high, parent, side = work.pop()
            node = len(self.span)
            split = self._ball(order, low, high)
            if parent >= 0:
                held = self.children[parent] or (0, 0)
                self.children[parent] = (node, held[1]) if side == 0 else (held[0], node)
            self.children.append(None)
            if split:
                work += [(split, high, node, 1), (low, split, node, 0)]
        # documents as the leaves have them
        cells = self._cells(order)
        self.place, self.value = self.place[cells], self.value[cells]
        self.first = np.append(0, np.cumsum(np.diff(self.first)[order]))
        self.order = order

    def _cells(self, rows: np.ndarray) -> np.ndarray:
        many = np.diff(self.first)[rows]
        return np.arange(int(many.sum())) + np.repeat(self.first[:-1][rows] - (np.cumsum(many) - many), many)

    def _ball(self, order: np.ndarray, low: int, high: int) -> int:
        """Add the ball of some documents; if they are many, sort them by side and say where to cut."""
        rows = order[low:high]
        cells = self._cells(rows)
        place, value = self.place[cells], self.value[cells].astype(float)
        starts = np.append(0, np.cumsum(np.diff(self.first)[rows]))[:-1]
        dot = lambda dense: np.add.reduceat(dense[place] * value, starts)
        norm = self.norm[rows]
        mean = np.bincount(place, value, self.width) / len(rows)
        far = norm - 2 * dot(mean) + mean @ mean
        # the difference of large squares keeps an error of their size
        self.radius.append(math.sqrt(max(far.max(), 0.0) + SLACK * SLACK * 1e6 * (norm.max() + mean @ mean)) * (1 + SLACK))
        self.means.append(mean)
        self.span.append((low, high))
        if len(rows) <= LEAF:
            return 0
        one = self._dense(rows[int(far.argmax())])
        other = self._dense(rows[int((norm - 2 * dot(one)).argmax())])
        order[low:high] = rows[np.argsort(dot(other - one), kind="stable")]
        return (low + high) // 2

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        part = slice(self.first[row], self.first[row + 1])
        out[self.place[part]] = self.value[part]
        return out

    def bounds(self, queries: Queries) -> np.ndarray:
        """No document of a node scores more with a query: nodes by queries."""
        dense = np.zeros((self.width, len(queries.ids)))
        for i, (p, c) in enumerate(zip(queries.places, queries.counts)):
            dense[p, i] = c
        length = np.array([math.sqrt(float(c @ c)) for c in queries.counts])
        product = np.array(self.means) @ dense
        return (product + np.outer(self.radius, length)) * (1 + SLACK) + 1

    def search(self, bound: np.ndarray, query: np.ndarray, ids: list[int], best: list, k: int, floor: int) -> None:
        """Put the documents that belong to the k best into ``best``, a heap of (score, -doc_id)."""
        need = best[0][0] if len(best) == k else floor
        open_ = [(-bound[0], 0)]
        while open_ and -open_[0][0] >= need:
            _, node = heapq.heappop(open_)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(open_, (-bound[child], child))
                continue
            low, high = self.span[node]
            part = slice(self.first[low], self.first[high])
            score = np.add.reduceat(query[self.place[part]] * self.value[part], self.first[low:high] - self.first[low])
            for at in np.flatnonzero(score >= need).tolist():
                found = (int(score[at]), -ids[self.order[low + at]])
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                need = max(need, best[0][0])


def _trees(batches: Iterator[pa.RecordBatch], weights: np.ndarray, corpus: Corpus) -> Iterator[tuple[list[int], Tree]]:
    """The documents of a task in trees of bounded size; those without a weighted term score nothing."""
    ids, places, values, cells = [], [], [], 0
    for batch in batches:
        for doc_id, n, place, count in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "places", "counts"))):
            place = np.frombuffer(place, "<u4").astype(np.int64)
            value = impacts(n, np.frombuffer(count, "<u4").astype(np.int64), weights[place], corpus)
            if not value.any():
                continue
            if ids and (len(ids) >= TREE_DOCS or cells + len(place) > TREE_CELLS):
                yield ids, Tree(places, values, len(weights))
                ids, places, values, cells = [], [], [], 0
            ids.append(LAST if doc_id is None else doc_id)
            places.append(place)
            values.append(value)
            cells += len(place)
    if ids:
        yield ids, Tree(places, values, len(weights))


def candidates(
    table: DataFrame, queries: Queries, weights: np.ndarray, corpus: Corpus, floors: list[int], k: int = TOP
) -> DataFrame:
    """query (its number in the block), doc_id, score: the k best of every task that reach the floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.ids]
        dense = np.zeros(len(weights), np.int64)
        for ids, tree in _trees(batches, weights, corpus):
            bounds = tree.bounds(queries)
            for q, (place, count) in enumerate(zip(queries.places, queries.counts)):
                dense[place] = count
                tree.search(bounds[:, q], dense, ids, best[q], k, floors[q])
                dense[place] = 0
        found = [(q, None if -d == LAST else -d, s) for q, held in enumerate(best) for s, d in held]
        number, doc_id, score = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
            ["query", "doc_id", "score"],
        )

    return table.mapInArrow(search, "query long, doc_id long, score long")


ORDER = (F.desc, "score"), (F.asc_nulls_last, "doc_id")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = top_k_per_group(found, ["query"], [how(c) for how, c in ORDER], k)
    rows = F.sort_array(
        F.collect_list(F.struct("score", (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("back"), "doc_id")), asc=False
    )
    each = best.groupBy("query").agg(rows.alias("rows")).select("query", F.posexplode("rows").alias("at", "row"))
    return each.select("query", (F.col("at") + 1).alias("rank"), "row.doc_id", "row.score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score.

    Statistics and floors are settled when this is called. What goes to the driver is bounded by a block
    of queries: its terms' document frequencies and one floor for each query.
    """
    parts, corpus = [], None
    kind = items.schema["item_id"].dataType.simpleString()
    for queries in query_blocks(items):
        table = written(projected(docs, queries.terms), "projected")
        if corpus is None:
            corpus = Corpus(*table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
        df = _document_frequencies(table, len(queries.terms))
        weights = np.array([weight(corpus.documents, int(n)) for n in df], np.int64)
        some = table.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0)
        first = _ranked(candidates(some, queries, weights, corpus, [1] * len(queries.ids), k), k)
        floors = [1] * len(queries.ids)
        for number, floor in first.filter(F.col("rank") == k).select("query", "score").collect():
            floors[number] = floor
        best = _ranked(candidates(table, queries, weights, corpus, floors, k), k)
        names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), f"query long, item_id {kind}")
        parts.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
