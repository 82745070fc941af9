"""How two tokenizers cut the same texts: groups of tokens that cover the same bytes, and which id
pairs stand together.

Each document is tokenized twice. All documents of a step are merged in lockstep: one state vector of
A and B positions moves on at once in all of them, the side whose token ends first (both where they end
together, which closes a group), and documents that are through leave the vector. The links of a
step are the token pairs of its groups.

How often an id pair is linked is counted over the whole corpus. A block is one row that keeps the
distinct pairs of its documents, so the shuffles carry each pair once for a block, not once for a
document: pairs are summed up by pair, and the sums go back to the blocks that have the pair. A block
is made step by step, so a worker holds the tokens of one step, and of a block its distinct pairs.

Defined results: texts that are missing, empty or not rendered byte for byte by both tokenizers have
zeros and an empty digest; a text of any length is one document of one block; repeated rows are
documents of their own, each counted; equal counts share the highest place of an id; a missing doc_id
is carried along; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from answerproof.llm import common, tokens
from answerproof.session import written

#: Bytes of text in a block; a longer text is a block by itself. Documents are aligned in steps of so
#: many tokens of both sides, and links are made in steps of so many.
BLOCK_BYTES, STEP_TOKENS, STEP_LINKS = 6 << 20, 1 << 20, 1 << 19
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
#: A pair is one number: the A id, then the B id in 24 bits, more than any vocabulary here needs.
PAIR_BITS, KEY_BITS = np.int64(24), np.int64(44)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a, first_b, stop_a) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, in A and in B tokens, for all documents of a block in order.

    ``ends_*``: byte offset behind each token, counted through the block; ``first_*`` and ``stop_a``:
    the tokens of each document that has any.
    """
    a, b, stop = first_a.copy(), first_b.copy(), stop_a.copy()
    cuts_a, cuts_b = [], []
    while len(a):
        x, y = ends_a[a], ends_b[b]
        np.add(a, x <= y, out=a)
        np.add(b, y <= x, out=b)
        cut = np.flatnonzero(x == y)
        if len(cut):
            at = a[cut]
            cuts_a.append(at)
            cuts_b.append(b[cut])
            through = at == stop[cut]
            if through.any():
                left = np.ones(len(a), bool)
                left[cut[through]] = False
                a, b, stop = a[left], b[left], stop[left]
    if not cuts_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # positions grow from document to document, so their order is that of the groups
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def linked(ids_a, ids_b, cuts_a, cuts_b, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair and number of links of every distinct pair of every document; ``doc`` is that
    of each group. Groups are taken in steps of bounded size; the parts of one very large group are
    its distinct ids."""
    from_a, from_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
    n_a, n_b = cuts_a - from_a, cuts_b - from_b
    size = n_a * n_b
    found = []

    def add(d: np.ndarray, pair: np.ndarray, many: np.ndarray | None = None) -> None:
        # document and pair in one number: A ids have 20 bits, documents of a block 19
        key = (d << KEY_BITS) | pair
        if many is None:
            found.append(np.unique(key, return_counts=True))
        else:
            found.append((key, many))

    big = np.flatnonzero(size > STEP_LINKS)
    for g in big.tolist():
        x, many_x = np.unique(ids_a[from_a[g] : cuts_a[g]], return_counts=True)
        y, many_y = np.unique(ids_b[from_b[g] : cuts_b[g]], return_counts=True)
        pair = (x[:, None] << PAIR_BITS) | y[None, :]
        add(np.full(pair.size, doc[g]), pair.ravel(), np.multiply.outer(many_x, many_y).ravel())
    rest = np.flatnonzero(size <= STEP_LINKS)
    total = np.cumsum(size[rest])
    low = 0
    while low < len(rest):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + STEP_LINKS, side="right")))
        g = rest[low:high]
        one = g[size[g] == 1]
        more = g[size[g] > 1]
        many = size[more]
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        of_a, of_b = np.divmod(nth, np.repeat(n_b[more], many))
        of_a += np.repeat(from_a[more], many)
        of_b += np.repeat(from_b[more], many)
        x = np.concatenate([ids_a[from_a[one]], ids_a[of_a]])
        y = np.concatenate([ids_b[from_b[one]], ids_b[of_b]])
        add(np.concatenate([doc[one], np.repeat(doc[more], many)]), (x << PAIR_BITS) | y)
        low = high
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    key, many = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        key, inverse = np.unique(key, return_inverse=True)
        many = np.bincount(inverse, many, len(key)).astype(np.int64)
    return key >> KEY_BITS, key & ((np.int64(1) << KEY_BITS) - 1), many


class Digits:
    """The ids of both sides as digits with what follows them, one 8-byte cell each."""

    def __init__(self, size_a: int, size_b: int):
        if max(size_a, size_b) > 10**7:
            raise ValueError("an id of more than seven digits")
        cells = [f"{i}{end}" for size, ends in ((size_a, ",|"), (size_b, ",;")) for end in ends for i in range(size)]
        self.cells = np.frombuffer(b"".join(c.encode().ljust(8, b"\0") for c in cells), np.uint64)
        self.shift = np.array([0, size_a, 2 * size_a, 2 * size_a + size_b])

    def order(self, ids_a, ids_b, cuts_a, cuts_b) -> np.ndarray:
        """The cells of a block's groups in the order they are written: A tokens, then B tokens."""
        n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[cuts_a - 1] = 1
        last_b[cuts_b - 1] = 1
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + np.repeat(cuts_b - n_b, n_a)] = ids_a + self.shift[last_a]
        out[np.arange(len(ids_b)) + np.repeat(cuts_a, n_b)] = ids_b + self.shift[2 + last_b]
        return out

    def digest(self, cells: np.ndarray) -> str:
        written_out = self.cells[cells].tobytes().translate(None, b"\0")
        return hashlib.sha256(written_out[:-1]).hexdigest()


class Pair:
    """The two tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens.byte_bpe(path_a), tokens.piece_bpe(path_b)
        self.bytes_a = np.array(list(map(len, self.a.pieces)), np.int64)
        self.bytes_b = np.array(list(map(len, self.b.pieces)), np.int64)
        self.digits = Digits(self.a.size, self.b.size)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        spaced = " " + text
        whole = spaced.encode()
        ids_a, ids_b = self.a.encode(spaced).astype(np.int64), self.b.encode(text)
        if b"".join(map(self.a.pieces.__getitem__, ids_a.tolist())) != whole:
            return none, none
        if b"".join(map(self.b.pieces.__getitem__, ids_b)) != whole:
            return none, none
        return ids_a, np.array(ids_b, np.int64)

    def step(self, found: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        """Figures of each document of a step from its tokens, and the pairs of each: ``until``, ``pair``
        and ``many`` links."""
        n_a, n_b = (np.array([len(x[i]) for x in found], np.int64) for i in (0, 1))
        ids_a, ids_b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        any_ = n_a > 0
        cuts_a, cuts_b = lockstep(
            np.cumsum(self.bytes_a[ids_a]),
            np.cumsum(self.bytes_b[ids_b]),
            (stop_a - n_a)[any_],
            (stop_b - n_b)[any_],
            stop_a[any_],
        )
        doc = np.searchsorted(stop_a, cuts_a, side="left")
        links = np.diff(cuts_a, prepend=0) * np.diff(cuts_b, prepend=0)
        sums = np.append(0, np.cumsum(links))
        upto = np.searchsorted(cuts_a, stop_a, side="right")
        since = np.append(0, upto[:-1])
        cells = self.digits.order(ids_a, ids_b, cuts_a, cuts_b)
        ends = stop_a + stop_b
        digests = [
            self.digits.digest(cells[e - k : e]) if k else "" for e, k in zip(ends.tolist(), (n_a + n_b).tolist())
        ]
        del cells
        which, pair, many = linked(ids_a, ids_b, cuts_a, cuts_b, doc)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": upto - since,
            "n_links": sums[upto] - sums[since],
            "groups_sha256": digests,
            "until": np.searchsorted(which, np.arange(len(found)), side="right"),
            "pair": pair,
            "many": many,
        }

    def steps(self, texts: list[str | None]) -> Iterator[dict]:
        found, size = [], 0
        for text in texts:
            ids_a, ids_b = self.encode(text)
            if found and size + len(ids_a) + len(ids_b) > STEP_TOKENS:
                yield self.step(found)
                found, size = [], 0
            found.append((ids_a, ids_b))
            size += len(ids_a) + len(ids_b)
        yield self.step(found)

    def block(self, texts: list[str | None]) -> dict:
        """Figures of each document, and the distinct pairs of the block with where they stand."""
        made = list(self.steps(texts))
        of = {c: np.concatenate([s[c] for s in made]) for c in (*FIGURES, "pair", "many")}
        pairs, place, holds = np.unique(of.pop("pair"), return_inverse=True, return_counts=True)
        before = np.cumsum([0, *(len(s["pair"]) for s in made[:-1])])
        return {
            **of,
            "groups_sha256": [d for s in made for d in s["groups_sha256"]],
            "pairs": pairs,
            "holds": holds,
            "until": np.concatenate([s["until"] + n for s, n in zip(made, before)]),
            "place": place,
        }


def _squeezed(x: np.ndarray, kind: str, rising: bool = False) -> bytes:
    """An array of numbers in few bytes; ``rising``: as differences."""
    x = np.diff(x.astype(np.int64), prepend=0) if rising else x
    return pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True)


def _restored(blob: bytes, size: int, kind: str, rising: bool = False) -> np.ndarray:
    if not size:
        return np.empty(0, np.int64)
    kept = np.frombuffer(pa.decompress(blob, size * np.dtype(kind).itemsize, "zstd"), kind)
    return np.cumsum(kept, dtype=np.int64) if rising else kept.astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of as many rows as have ``limit`` bytes of text together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            text = text.as_py()
            if texts and size + len(text or "") > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            size += len(text or "") + 64
    if texts:
        yield ids, texts


def blocks(docs: DataFrame, path_a: str = tokens.BYTE_BPE, path_b: str = tokens.PIECE_BPE) -> DataFrame:
    """One row for each block of documents: their figures, and its pairs in squeezed arrays."""
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = Pair(path_a, path_b), TaskContext.get().partitionId()
        for nth, (ids, texts) in enumerate(_grouped(batches, BLOCK_BYTES)):
            b = both.block(texts)
            row = {
                "block": pa.array([(part << 32) + nth], pa.int64()),
                "doc_id": pa.array([ids], pa.list_(kind)),
                **{c: pa.array([b[c].tolist()], pa.list_(pa.int64())) for c in FIGURES},
                "groups_sha256": pa.array([b["groups_sha256"]], pa.list_(pa.string())),
                "until": pa.array([b["until"].tolist()], pa.list_(pa.int64())),
                "n_pairs": pa.array([len(b["pairs"])], pa.int64()),
                "pairs": pa.array([_squeezed(b["pairs"], "<i8", True)], pa.binary()),
                "holds": pa.array([_squeezed(b["holds"], "<u4")], pa.binary()),
                "place": pa.array([_squeezed(b["place"], "<i4", True)], pa.binary()),
                "many": pa.array([_squeezed(b["many"], "<i8")], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    common.bounded_batches(docs.sparkSession)
    numbers = ", ".join(f"{c} array<long>" for c in FIGURES)
    schema = (
        f"block long, doc_id array<{docs.schema['doc_id'].dataType.simpleString()}>, {numbers}, groups_sha256 array<string>, "
        "until array<long>, n_pairs long, pairs binary, holds binary, place binary, many binary"
    )
    return docs.select("doc_id", "text").mapInArrow(align, schema)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, n, pairs, holds in zip(*(batch.column(c).to_pylist() for c in ("block", "n_pairs", "pairs", "holds"))):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block, np.int64)),
                    pa.array(_restored(pairs, n, "<i8", True)),
                    pa.array(_restored(holds, n, "<u4")),
                ],
                ["block", "pair", "docs"],
            )


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, docs, best: in how many documents each id pair is linked, and whether no other pair of
    its A id is in more. An id has at most as many pairs as the other vocabulary has ids."""
    each = made.select("block", "n_pairs", "pairs", "holds").mapInArrow(_pairs_of, "block long, pair long, docs long")
    total = each.groupBy("pair").agg(F.sum("docs").alias("docs"))
    of_a = Window.partitionBy(F.shiftright("pair", int(PAIR_BITS)))
    return total.withColumn("best", F.col("docs") == F.max("docs").over(of_a))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs, as documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            until = np.array(row["until"].as_py(), np.int64)
            n_best, count_sum = np.zeros(len(until), np.int64), np.zeros(len(until), np.int64)
            if row["n_pairs"].as_py():
                counts = row["counts"].values
                pair, docs = (counts.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "docs"))
                best = counts.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(pair)
                links = int(until[-1])
                place = order[_restored(row["place"].as_py(), links, "<i4", True)]
                many = _restored(row["many"].as_py(), links, "<i8")
                upto = np.append(0, until)
                for out, value in ((n_best, best), (count_sum, docs)):
                    out[:] = np.diff(np.append(0, np.cumsum(many * value[place]))[upto])
            yield pa.RecordBatch.from_arrays(
                [
                    row["doc_id"].values,
                    *(row[c].values for c in FIGURES),
                    pa.array(n_best),
                    pa.array(count_sum),
                    row["groups_sha256"].values,
                ],
                ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"],
            )


def align(docs: DataFrame, path_a: str = tokens.BYTE_BPE, path_b: str = tokens.PIECE_BPE) -> DataFrame:
    """Figures of every document: tokens of both sides, groups, links, links whose count is the
    highest of their A id, counts summed over links, and the digest of its groups.

    Blocks and counts are written when this is called.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(blocks(docs, path_a, path_b), "blocks")
    counts = written(pair_counts(made), "pairs")
    each = made.select("block", "n_pairs", "pairs", "holds").mapInArrow(_pairs_of, "block long, pair long, docs long")
    back = each.drop("docs").join(counts, "pair").groupBy("block").agg(
        F.collect_list(F.struct("pair", "docs", "best")).alias("counts")
    )
    whole = made.drop("pairs", "holds").join(back, "block", "left")
    numbers = ", ".join(f"{c} long" for c in (*FIGURES, "n_best", "count_sum"))
    return whole.mapInArrow(_settled, f"doc_id {kind}, {numbers}, groups_sha256 string")
