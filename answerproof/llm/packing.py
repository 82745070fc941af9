"""Training sequences by concatenating and cutting.

All documents, each closed by an end token, form one stream of tokens that is cut every ``WINDOW``
tokens. Two passes give every token its place: the first tokenizes each document once and numbers its
tokens within the partition, the partitions' totals are summed up (one number a partition), and the
second pass cuts each document at the window ends its global offset meets. Documents are not shuffled.
Windows that begin in one batch of rows and end in another leave boundary records; ``sequences`` puts
only these together by a shuffle.

Only the last window of the whole table can be short, so less than one window is padding in all.

Defined results: a missing or empty text is its end token alone; a text of any length is cut into as
many windows as it needs; repeated rows and equal ids are documents of their own; a missing doc_id is
carried along; an empty table gives no rows; other columns of the table are never read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerproof.llm import common, tokens
from answerproof.session import written

WINDOW = 2048
END = 1  # id that closes a document


def _width(path: str) -> str:
    """Bytes an id is stored in: two where the vocabulary allows."""
    return "<u2" if tokens.byte_bpe(path).size <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str = tokens.BYTE_BPE, end: int = END) -> DataFrame:
    """doc_id, ids (binary, little-endian), n_tokens, part, before: the tokens of each document and
    how many the rows ahead of it in its partition have."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, width = tokens.byte_bpe(path), _width(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, many = [], []
            for text in batch.column("text"):
                found = np.append(bpe.encode(text.as_py() or "", special=True), np.uint32(end))
                ids.append(found.astype(width).tobytes())
                many.append(len(found))
            n = np.array(many, np.int64)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ids, pa.binary()),
                    pa.array(n),
                    pa.array(np.full(len(n), part, np.int64)),
                    pa.array(ends - n),
                ],
                ["doc_id", "ids", "n_tokens", "part", "before"],
            )
            before += int(n.sum())

    common.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, n_tokens long, part long, before long"
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def placed(docs: DataFrame, path: str = tokens.BYTE_BPE, end: int = END) -> DataFrame:
    """The token table with each document's offset in the stream of all tokens (``first``).

    The table is written once, when this is called, so a lost executor changes neither tokens nor
    order. The running totals have one row for each partition of the input.
    """
    table = written(tokenized(docs, path, end), "tokens")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base")), "totals")
    return table.join(starts, "part").select(
        "doc_id", "ids", "n_tokens", (F.col("base") + F.col("before")).alias("first")
    )


def _cuts(first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Row, window, begin and end in the stream of every piece."""
    begin, last = first // window, (first + n - 1) // window
    many = last - begin + 1
    row = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[row] + nth
    return row, at, np.maximum(first[row], at * window), np.minimum((first + n)[row], (at + 1) * window)


def pieces(table: DataFrame, window: int = WINDOW, path: str = tokens.BYTE_BPE) -> DataFrame:
    """The pieces of every document of ``placed``: where it begins in the document, its length, crc32
    of its ids, tokens of the document, and its window and place there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(path)
        for batch in batches:
            first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "n_tokens"))
            row, at, begin, stop = _cuts(first, n, window)
            start, length = begin - first[row], stop - begin
            held = [np.frombuffer(x.as_buffer(), width).astype("<u4") for x in batch.column("ids")]
            sums = [zlib.crc32(held[r][a : a + k]) for r, a, k in zip(row.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    *map(pa.array, (start, length)),
                    pa.array(sums, pa.int64()),
                    *map(pa.array, (n[row], at, begin - at * window)),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = table.schema["doc_id"].dataType.simpleString()
    numbers = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return table.mapInArrow(cut, f"doc_id {kind}, {numbers}")


def sequences(table: DataFrame, window: int = WINDOW, path: str = tokens.BYTE_BPE) -> DataFrame:
    """The sequences themselves: sequence_id and ids (array), from ``placed``.

    Each batch joins what lies side by side in it. A window that is whole goes out as it is; the
    others are boundary records, of which a window has no more than it has tokens, and only these are
    grouped by window.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(path)
        for batch in batches:
            first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "n_tokens"))
            held = [np.frombuffer(x.as_buffer(), width) for x in batch.column("ids")]
            row, at, begin, stop = _cuts(first, n, window)
            order = np.argsort(begin, kind="stable")
            runs: list[tuple[int, int, int, list[np.ndarray]]] = []
            for i in order.tolist():
                r, b, e = int(row[i]), int(begin[i]), int(stop[i])
                ids = held[r][b - int(first[r]) : e - int(first[r])]
                if runs and runs[-1][2] == b and b % window:
                    runs[-1][3].append(ids)
                    runs[-1] = (*runs[-1][:2], e, runs[-1][3])
                else:
                    runs.append((int(at[i]), b, e, [ids]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in runs], pa.int64()),
                    pa.array([x[1] - x[0] * window for x in runs], pa.int64()),
                    pa.array([x[2] - x[1] == window for x in runs], pa.bool_()),
                    pa.array([np.concatenate(x[3]).astype(np.int64) for x in runs], pa.list_(pa.int64())),
                ],
                ["sequence_id", "offset", "whole", "ids"],
            )

    found = table.mapInArrow(joined, "sequence_id long, offset long, whole boolean, ids array<long>")
    found = written(found, "windows")
    inside = found.filter("whole").select("sequence_id", "ids")
    cut = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    boundary = found.filter("not whole").groupBy("sequence_id").agg(F.flatten(F.transform(cut, lambda x: x["ids"])).alias("ids"))
    return inside.unionByName(boundary)


def pack(docs: DataFrame, window: int = WINDOW, path: str = tokens.BYTE_BPE, end: int = END) -> DataFrame:
    """Every document in pieces of sequences of ``window`` tokens; see the module for what is where."""
    return pieces(placed(docs, path, end), window, path)
