"""Fixity audit of web archives with Merkle trees.

The records of an archive, in the order of their offsets, are the leaves of a tree; a node covers a
range of offsets and hashes the ranges and digests below it. Two replicas agree if their roots do.
Where roots differ, only children of differing nodes are compared, level by level, down to the
records. Only digests and offsets are shuffled, never record bytes.

Leaves hash their offsets, so one record of another length makes all later ones differ. The records
found by the descent are therefore matched by content and then by name, which tells those that changed
from those that only moved, went missing or came in.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerproof.session import written

FANOUT = 16
ARCHIVE_RECORDS = 1_000  # records of an archive, on average


def warc_record(page_id: str = "page_id", url: str = "url", html: str = "html"):
    """The bytes of a WARC response record; missing fields are empty."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    target = F.coalesce(F.col(url), F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), target).cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"),
        name,
        F.lit(">\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archived(pages: DataFrame, archives: int | None = None) -> DataFrame:
    """Records of pages laid out in archives: archive, record (the page id), offset, length, digest.

    Pages are dealt to archives by a hash of the id, as many archives as the table needs, and lie
    there in the order of the id, then of the digest. A missing id comes first in its archive, which
    the url decides, or the digest where that is missing too. Missing fields are empty in the record;
    pages repeated as a whole are records of their own; an empty table gives no records. Other columns
    of ``pages`` play no part.
    """
    if archives is None:
        archives = max(1, -(-pages.count() // ARCHIVE_RECORDS))
    made = pages.select(F.col("page_id").alias("record"), "url", warc_record().alias("bytes"))
    text = F.coalesce(F.col("record").cast("string"), "url", F.sha2("bytes", 256)).cast("binary")
    rows = made.select(
        F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(archives)).alias("archive"),
        "record",
        F.octet_length("bytes").cast("bigint").alias("length"),
        F.sha2("bytes", 256).alias("digest"),
    )
    order = Window.partitionBy("archive").orderBy("record", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("offset", before)


_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_START = re.compile(rb"WARC/\d\.\d\r\n|\x1f\x8b\x08")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)
_NAME = re.compile(rb"\r\nWARC-Record-ID:\s*(\S+)", re.I)
_END = b"\r\n\r\n"
CHUNK = 65_536  # compressed bytes inflated at a time


def _member(data: bytes, at: int) -> tuple[int, bytes] | None:
    """End and beginning of the gzip member at ``at``; None if it is damaged, checksum included."""
    inflate, view, head, pos = zlib.decompressobj(31), memoryview(data), b"", at
    try:
        while not inflate.eof and pos < len(data):
            part = view[pos : pos + CHUNK]
            plain = inflate.decompress(part)
            head = head if _END in head else head + plain
            pos += len(part)
    except zlib.error:
        return None
    if not inflate.eof or not _VERSION.match(head):
        return None
    return pos - len(inflate.unused_data), head.partition(_END)[0] + b"\r\n"


class _Plain:
    """Records that are not compressed. Marks are searched once, as positions only rise."""

    def __init__(self, data: bytes):
        self.data, self.blank, self.following = data, -1, -1

    def at(self, at: int) -> tuple[int, bytes] | None:
        """End and header of the record at ``at``; None if it is damaged."""
        data = self.data
        if self.blank < at:
            found = data.find(_END, at)
            self.blank = found if found >= 0 else len(data)
        if self.following <= at:
            following = _VERSION.search(data, at + 1)
            self.following = following.start() if following else len(data)
        if self.blank == len(data) or self.following < self.blank:  # no end, or another record before it
            return None
        head = data[at : self.blank + 2]
        size = _LENGTH.search(head)
        if not size:
            return None
        end = self.blank + 4 + int(size[1]) + 4
        return (end, head) if data[end - 4 : end] == _END else None


def _records(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """Offset, length and header of the records of a file, plain or with a gzip member for each.

    Together they cover the file. What is no whole record (a cut or foreign header, a length that does
    not lead to a record's end, a member that fails its checksum, foreign bytes) is a range without a
    header, up to the next place where a whole record begins.
    """
    plain, at, bad = _Plain(data), 0, None
    while at < len(data):
        found = None
        if data.startswith(b"\x1f\x8b\x08", at):
            found = _member(data, at)
        elif _VERSION.match(data, at):
            found = plain.at(at)
        if found:
            if bad is not None:
                yield bad, at - bad, None
                bad = None
            yield at, found[0] - at, found[1]
            at = found[0]
        else:
            bad = at if bad is None else bad
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
    if bad is not None:
        yield bad, at - bad, None


def read_warc(spark, path: str) -> DataFrame:
    """archive (path), record (its WARC-Record-ID), offset, length, digest of the files at ``path``, and
    ``damaged``: ranges that are no whole record, without a name, as ``_records`` finds them.

    A task holds one file at a time; archives are cut into files of about a gigabyte by custom. An empty
    file has no records.
    """

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows = []
                for at, size, head in _records(data):
                    named = _NAME.search(head or b"")
                    record = named[1].decode("utf-8", "replace") if named else None
                    rows.append((name, record, at, size, _sha256(memoryview(data)[at : at + size]), head is None))
                yield pd.DataFrame(rows, columns=["archive", "record", "offset", "length", "digest", "damaged"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "archive string, record string, offset long, length long, digest string, damaged boolean"
    return files.mapInPandas(parse, schema)


def _sha256(data: bytes | memoryview) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def write_warc_file(path: str, records: list[bytes], packed: bool = False) -> None:
    """A small archive, for exports and tests."""
    with open(path, "wb") as out:
        for r in records:
            out.write(gzip.compress(r) if packed else r)


def leaves(records: DataFrame) -> DataFrame:
    """archive, idx (0, 1, ... by offset), start, end, digest of the leaf, record, content (its digest)."""
    order = Window.partitionBy("archive").orderBy("offset", "digest")
    end = F.col("offset") + F.col("length")
    digest = F.sha2(
        F.concat_ws(":", F.lit("leaf"), F.col("offset").cast("string"), end.cast("string"), "digest").cast("binary"), 256
    )
    return records.select(
        "archive",
        (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
        F.col("offset").alias("start"),
        end.alias("end"),
        digest.alias("digest"),
        F.col("record").cast("string").alias("record"),
        F.col("digest").alias("content"),
    )


def tree(records: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees, leaves first; at ``height`` each archive has its root."""
    levels = [written(leaves(records), "merkle")]
    for _ in range(height):
        below = levels[-1]
        child = F.struct("idx", "start", "end", "digest")
        parents = below.groupBy("archive", F.floor(F.col("idx") / fanout).alias("idx")).agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sort_array(F.collect_list(child)).alias("below"),
        )
        body = F.array_join(
            F.transform(
                "below",
                lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["digest"]),
            ),
            ",",
        )
        digest = F.sha2(F.concat(F.lit("node:"), body).cast("binary"), 256)
        levels.append(written(parents.select("archive", "idx", "start", "end", digest.alias("digest")), "merkle"))
    return levels


def height_for(*replicas: DataFrame, fanout: int = FANOUT) -> int:
    most = max(
        r.groupBy("archive").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 for r in replicas
    )
    height = 1
    while fanout**height < most:
        height += 1
    return height


def _numbered(side: DataFrame, name: str) -> DataFrame:
    """With ``n``: which of its archive's records with the same ``name`` a record is, by offset."""
    order = Window.partitionBy("archive", name).orderBy("start", "idx")
    return side.withColumn("n", F.row_number().over(order))


def _matched(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """x, y: records of the two replicas with the same archive, ``name`` and number, or one of them."""
    one, two = _numbered(left, name), _numbered(right, name)
    one = one.select(F.struct(*one.columns).alias("x"))
    two = two.select(F.struct(*two.columns).alias("y"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("archive", name, "n")]
    return one.join(two, same[0] & same[1] & same[2], "full")


def _told_apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """What became of the records that differ: one row each, with its ``status``.

    Equal content is a record that moved. Of the rest, equal names are a record that changed; then a
    record is only in the left replica, or only in the right one. Among equals the order of offsets
    decides.
    """
    by_content = written(_matched(left, right, "content"), "audit")
    moved = by_content.filter("x is not null and y is not null").withColumn("status", F.lit("shifted"))
    fields = [c for c in left.columns]
    gone = by_content.filter("y is null").select(*[f"x.{c}" for c in fields])
    new = by_content.filter("x is null").select(*[f"y.{c}" for c in fields])
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").otherwise("changed")
    rest = _matched(gone, new, "record").withColumn("status", status)
    return moved.unionByName(rest).select(
        F.lit("record").alias("what"),
        *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("archive", "idx", "start", "end", "record")],
        F.col("x.content").alias("left"),
        F.col("y.content").alias("right"),
        F.lit(False).alias("same"),
        "status",
        (F.col("y.start") - F.col("x.start")).alias("moved"),
    )


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Compare two replicas (archive, record, offset, length, digest); other columns play no part.

    Rows: what ("root" of each archive, or "record" that differs), archive, idx, start, end (place in
    the left replica, or in the right one where only that has it), record, left and right (digests; NULL
    where a replica has none), same, status, moved.

    Roots are ``same`` or ``differs``. Records are ``changed`` (another content under the name),
    ``shifted`` (the same content elsewhere, as behind a record that became longer), ``missing`` or
    ``added``; ``moved`` is the distance in bytes, NULL where a replica lacks the record. An archive
    that one replica lacks differs as a whole. Records without a name are matched by their order;
    repeated records too. Two empty replicas give no rows.
    """
    height = height_for(left, right, fanout=fanout)
    a, b = tree(left, height, fanout), tree(right, height, fanout)
    roots = suspect = None
    for level in range(height, -1, -1):
        one, two = a[level], b[level]
        if suspect is not None:
            inside = suspect.select(F.col("archive").alias("p_archive"), F.col("idx").alias("p_idx"))
            on = F.col("archive").eqNullSafe(F.col("p_archive")) & (F.floor(F.col("idx") / fanout) == F.col("p_idx"))
            one, two = one.join(inside, on, "left_semi"), two.join(inside, on, "left_semi")
        one = one.select(F.col("archive").alias("a1"), F.col("idx").alias("i1"), F.struct(*one.columns).alias("x"))
        two = two.select(F.col("archive").alias("a2"), F.col("idx").alias("i2"), F.struct(*two.columns).alias("y"))
        pairs = one.join(two, F.col("a1").eqNullSafe(F.col("a2")) & (F.col("i1") == F.col("i2")), "full")
        pairs = pairs.withColumn("same", F.coalesce(F.col("x.digest") == F.col("y.digest"), F.lit(False)))
        pairs = written(pairs if level == height else pairs.filter("not same"), "audit")
        if level == height:
            roots = pairs.select(
                F.lit("root").alias("what"),
                *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("archive", "idx", "start", "end")],
                F.lit(None).cast("string").alias("record"),
                F.col("x.digest").alias("left"),
                F.col("y.digest").alias("right"),
                "same",
                F.when(F.col("same"), "same").otherwise("differs").alias("status"),
                F.lit(None).cast("bigint").alias("moved"),
            )
        suspect = pairs.filter("not same").select(
            F.coalesce("x.archive", "y.archive").alias("archive"), F.coalesce("i1", "i2").alias("idx")
        )
    fields = ("archive", "idx", "start", "end", "record", "content")
    ours, theirs = (
        pairs.filter(f"{side} is not null").select(*[F.col(f"{side}.{c}").alias(c) for c in fields]) for side in "xy"
    )
    return roots.unionByName(_told_apart(ours, theirs))


def fold_shifted(found: DataFrame) -> DataFrame:
    """The rows of ``audit`` with each run of neighbouring records that moved by the same distance as one
    row: ``records`` counts them, start and end span them, ``record`` is the first one's name, and the
    digests are NULL if there are several. All other rows have 1 in ``records``, roots NULL.

    So the report grows with the damage, not with what lies behind it.
    """
    shifted = F.col("status") == "shifted"
    along = Window.partitionBy("archive", "moved").orderBy("idx")
    runs = found.filter(shifted).withColumn("run", F.col("idx") - F.row_number().over(along))
    alone = F.count("*") == 1
    runs = runs.groupBy("archive", "moved", "run").agg(
        F.min("idx").alias("idx"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("record", "idx").alias("record"),
        F.when(alone, F.min("left")).alias("left"),
        F.when(alone, F.min("right")).alias("right"),
        F.count("*").alias("records"),
    )
    runs = runs.withColumns({"what": F.lit("record"), "same": F.lit(False), "status": F.lit("shifted")})
    rest = found.filter(~shifted).withColumn("records", F.when(F.col("what") == "record", F.lit(1).cast("bigint")))
    return rest.unionByName(runs.drop("run"))
