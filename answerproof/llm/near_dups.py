"""Near duplicates by ProbMinHash: signatures of weighted shingles, bands, exact verification.

A text is the bag of its five-word shingles, weighted by how often each occurs. Every shingle is a
Poisson process whose rate is its weight; the arrival that comes first in a slot of the signature
names the slot. Two texts agree in a slot with the probability Jaccard similarity of their weights,
whose complement is a metric. A process is abandoned as soon as its next arrival is later than the
latest slot, hence the cost is about one arrival per shingle plus a few per slot.

Equal texts are joined first and go on as one. Members of a band are compared with two hubs of the
band, never with each other: linked texts need no further comparison among themselves. The first hub
is the member that shares most bands with others, usually the original of a family of copies. What
remains are bands whose members fall into several components. There, pairs from different components
are compared exactly, unless a bound rules them out: a shingle that no other text of such bands has
cannot be shared, and enough of these keep two texts apart; so do enough bits in which the parities
of two texts' shingles differ. Links are verified on whole texts; components are found by star
contraction over tables. Nothing is collected.
"""

from __future__ import annotations

import functools
import operator
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.session import discard, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6  # a pair at 0.8 shares no band with probability 6e-5
BATCH_CHARS = 400_000
MARK_WORDS = 1 << 20  # words of 64 bits: 3 % of the rows pass unneeded where two million keys are needed
PARITY_WORDS = 32  # words of 64 bits; settles nearly all pairs of up to 1,500 shingles without their lists
_WORD_IDS = 200_000  # remembered word hashes of a worker; beyond it the memory starts anew


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _WORD_IDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_word_hash = _Hashes()


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the five-word shingles, repeats included; fewer words are one shingle."""
    words = common.TOKEN.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter((_word_hash[w] for w in words), np.uint64, len(words))
    n = max(1, len(ids) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(ids))):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n])
    return out


def weigh(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of several texts: number of the text, hash, weight."""
    parts = [shingles(t) for t in texts]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(every):
        return owner, every, np.empty(0)
    order = np.lexsort((every, owner))
    owner, every = owner[order], every[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (every[1:] != every[:-1])]))
    return owner[new], every[new], np.diff(np.append(new, len(every))).astype(float)


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The slots of each text as a (texts, m) table of shingle hashes."""
    best = np.full(texts * m, np.inf)
    who = np.zeros(texts * m, np.uint64)
    seed = common.mix(shingle + np.uint64(0x5851F42D4C957F2D))
    when = np.zeros(len(shingle))
    alive = np.arange(len(shingle))
    step = 0
    while len(alive):
        step += 1
        draw = common.mix(seed[alive] + np.uint64(2 * step * 0x9E3779B97F4A7C15 % 2**64))
        uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        when[alive] -= np.log(uniform) / weight[alive]
        slot = (common.mix(draw + np.uint64(1)) % np.uint64(m)).astype(np.int64) + owner[alive] * m
        t = when[alive]
        np.minimum.at(best, slot, t)
        won = best[slot] == t
        who[slot[won]] = shingle[alive[won]]
        latest = best.reshape(texts, m).max(axis=1)
        alive = alive[t < latest[owner[alive]]]
    return who.reshape(texts, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows])
    return out.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bit i of ``PARITY_WORDS`` words is set if an odd number of the distinct ``hashes`` falls on i.

    Equal hashes cancel out between two texts, so they differ in as many shingles as in bits, or more.
    """
    bits = 64 * PARITY_WORDS
    odd = np.bincount((hashes.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes and weights), exactly."""
    both = np.intersect1d(a, b, assume_unique=True)
    if not len(both):
        return 0.0
    ia, ib = np.searchsorted(a, both), np.searchsorted(b, both)
    u, v = x[ia].astype(float), y[ib].astype(float)
    ratio = v / u
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    # sum over all elements j of max(u_j, v_j / ratio_i); elements of one side only add their weight
    up_to, after = np.cumsum(u), v.sum() - np.cumsum(v)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    only_a, only_b = x.sum() - u.sum(), y.sum() - v.sum()
    total = up_to[last] + only_a + (after[last] + only_b) / ratio
    return float((u / total).sum())


def _key(text: Column) -> Column:
    """16-byte name of a text."""
    return F.unhex(common.text_key(text))


def _banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """tid, bands: once for each distinct text with a word, with the smallest id that has it."""

    @F.pandas_udf("array<long>")
    def keys(text: pd.Series) -> pd.Series:
        out: list = []
        texts: list[str] = common.texts_of(text)
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            owner, shingle, weight = weigh(texts[start:end])
            table = band_keys(signatures(owner, shingle, weight, end - start, bands * rows), bands, rows)
            filled = set(owner.tolist())
            out += [table[i] if i in filled else np.empty(0, np.int64) for i in range(end - start)]
            start = end
        return pd.Series(out)

    named = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", _key(F.col("text")).alias("tid"), keys("text").alias("bands")
    )
    # partial results leave one row for each distinct text and task
    return named.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))


def _marked(rows: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``needed``, and some others: all whose hash falls on a set bit.

    The bits are a broadcast table of ``MARK_WORDS`` words at most, however many keys are needed. An
    exact join after it then shuffles about the rows that are needed, not every row; with so many keys
    that all bits are set, it shuffles every row.
    """
    place = F.pmod(F.xxhash64(key), F.lit(64 * MARK_WORDS))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    marks = needed.groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))
    # a semi join: an exact one is not pushed below it, as it would be below an inner join
    on = (word == F.col("__word")) & (F.getbit("__bits", bit) == 1)
    return rows.join(F.broadcast(marks), on, "left_semi")


def _profiles(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """tid, shingle hashes (sorted) and weights of the texts in ``needed`` (tid)."""
    named = _marked(docs.select(_key(F.col("text")).alias("tid"), "text"), needed, "tid")
    texts = named.join(needed, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))

    @F.pandas_udf("struct<h: array<long>, w: array<int>>")
    def profile(text: pd.Series) -> pd.DataFrame:
        rows = [weigh([t])[1:] for t in common.texts_of(text)]
        ordered = []
        for h, w in rows:
            h = h.view(np.int64)
            by = np.argsort(h)
            ordered.append((h[by], w[by].astype(np.int32)))
        return pd.DataFrame({"h": [h for h, _ in ordered], "w": [w for _, w in ordered]})

    return texts.select("tid", profile("text").alias("p"))


def _verified(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs`` (hub, tid) with their exact similarity."""

    @F.pandas_udf("double")
    def exact(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(*row) for row in zip(a, x, b, y)], dtype=float)

    # both sides get new names, so that one shuffle of the profiles serves both joins
    one, other = (profiles.select(F.col("tid").alias(t), F.col("p").alias(p)) for t, p in (("hub", "q"), ("to", "r")))
    hubs = one.join(pairs.select("hub").distinct(), "hub")
    joined = pairs.join(other, F.col("tid") == F.col("to")).join(hubs, "hub")
    return joined.select("hub", "tid", exact("q.h", "q.w", "r.h", "r.w").alias("similar"))


def _settled(links: DataFrame) -> bool:
    """Whether ``links`` (u > v, distinct) are stars around their smallest nodes: no node has two lower
    neighbours, and none that has one is a lower neighbour itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    each = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return each.agg(F.count_if((F.col("above") > 1) | (F.col("above") * F.col("below") > 0))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of ``edges`` (u, v): the smallest node it is connected to.

    Alternating large-star and small-star steps until only stars are left; a few steps even for
    long chains. Each step is a table of its own, so a lost executor repeats one step at most.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = written(links.filter("u != v").distinct(), "links")
    while not _settled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        large = written(large, "large-stars")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        old, links = links, written(small, "links")
        discard(old, least, large, lower)  # the new links are a table, nothing reads these again
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    # every node that is no root has one link, so nothing stands twice
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def classes(docs: DataFrame, threshold: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tid, class_id, first: every distinct (doc_id, text) with its class.

    ``class_id`` is the smallest doc_id of the class, ``first`` marks the one document that stays
    (smallest id, then text key; missing ids last). Equal texts are alike, empty ones too; missing
    texts are alike to nothing. Texts without a word have no shingles and equal only themselves.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    reps = written(_banded(docs, bands, rows), "signatures")
    member = reps.select("tid", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    # aggregates that meet hot keys again are written first: a join can then split such a key
    sizes = written(sizes, "band-sizes")
    crowded = written(_marked(member, sizes, "band").join(sizes, "band"), "bands")  # members of bands that hold two or more
    known_by = crowded.groupBy("tid").agg(F.sum("n").alias("fame"))
    famed = crowded.select("band", "tid").join(known_by, "tid")
    hubs = famed.groupBy("band").agg(F.max(F.struct("fame", "tid"))["tid"].alias("top"), F.min("tid").alias("low"))
    hubs = hubs.select("band", F.array_distinct(F.array("top", "low")).alias("hubs"))
    met = crowded.select("band", "tid").join(written(hubs, "hubs"), "band")
    pairs = met.select("tid", F.explode("hubs").alias("hub")).filter("tid != hub")
    pairs = written(pairs.distinct(), "pairs")
    needed = pairs.select("tid").unionByName(pairs.select(F.col("hub").alias("tid"))).distinct()
    profiles = written(_profiles(docs, needed), "profiles")
    known = written(_verified(pairs, profiles), "similarities")
    links = known.filter(F.col("similar") >= threshold).select(F.col("hub").alias("u"), F.col("tid").alias("v"))
    parts = components(links)
    rest = _remaining(crowded, parts, profiles, known, threshold)
    if not rest.isEmpty():
        more = written(_verified(rest, profiles).filter(F.col("similar") >= threshold), "similarities")
        if not more.isEmpty():
            stars = parts.select(F.col("node").alias("u"), F.col("label").alias("v"))
            parts = components(stars.unionByName(more.select(F.col("hub").alias("u"), F.col("tid").alias("v"))))
        discard(more)
    discard(sizes, crowded, pairs, profiles, known, rest)  # the components are a table by now
    label = F.coalesce("label", "tid")
    own = reps.join(parts, F.col("tid") == F.col("node"), "left").select("tid", "doc_id", label.alias("label"))
    lowest = own.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first")
    )
    placed = own.select("tid", "label").join(written(lowest, "classes"), "label").select("tid", F.col("first.doc_id").alias("class_id"), F.col("first").alias("f"))
    every = docs.filter(F.col("text").isNotNull()).select("doc_id", _key(F.col("text")).alias("tid")).distinct()
    found = every.join(placed, "tid").select(
        "doc_id",
        "tid",
        "class_id",
        (common.same(F.col("doc_id"), F.col("f.doc_id")) & (F.col("tid") == F.col("f.tid"))).alias("first"),
    )
    return found


def _remaining(
    crowded: DataFrame, parts: DataFrame, profiles: DataFrame, known: DataFrame, threshold: float
) -> DataFrame:
    """Pairs (hub, tid) of a band that lie in different components and could still be similar; written.

    With d distinct shingles of total weight n, k of them (weight c) not unique here, at most
    m = min(k, k') are shared. A side's shared mass is then at most p = min(c, n - d + m) / n, and the
    similarity at most p q / (p + q - p q). Without c, this bound is one on the number of shingles that
    only one side has. That number is at least the number of bits in which ``parities`` differ; where
    these settle nothing, it is counted, and what comes out are links, but for weights that differ. A
    pair is counted in the lowest band it shares.

    A band has far more pairs than links, so they are made as few and as cheap as can be. Pairs within
    its largest component are not made: one side is always a member outside of it. The condition of the
    join is numbers and words of bits alone, a method small enough for the JVM to compile, with the
    lists behind a fence. Bands with the same members give the same pairs, so one of them is looked at;
    a text is copied for each of these only. Its shingles go along as 32 bits of their hashes. Two that
    fall together could hide a shared one, so the count is raised by how many did; shingles that look
    alike raise it too.
    """
    labelled = crowded.select("band", "tid").join(parts, F.col("tid") == F.col("node"), "left")
    labelled = labelled.select("band", "tid", F.coalesce("label", "tid").alias("label"))
    members = [F.bit_xor(F.xxhash64(F.lit(i), "tid")).alias(f"x{i}") for i in (1, 2)]
    mixed = labelled.groupBy("band").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), *members
    )
    mixed = mixed.filter("a != b").groupBy("n", "x1", "x2").agg(F.min("band").alias("band"))
    mixed = written(mixed.select("band"), "mixed-bands")
    placed = written(labelled.join(mixed, "band"), "mixed")
    largest = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
    largest = written(largest.groupBy("band").agg(F.max(F.struct("n", "label"))["label"].alias("largest")), "largest")
    inside = placed.join(largest, "band").withColumn("apart", F.col("label") != F.col("largest")).drop("largest")

    @F.pandas_udf("array<long>")
    def parity(h: pd.Series) -> pd.Series:
        return pd.Series([parities(x) for x in h], dtype=object)

    held = profiles.join(placed.select("tid").distinct(), "tid").withColumn("bits", parity("p.h"))
    held = written(held, "held")  # read twice
    each = held.select("tid", F.explode(F.arrays_zip("p.h", "p.w")).alias("s")).select("tid", "s.h", "s.w")
    unique = each.groupBy("h").agg(F.count("*").alias("n"), F.min("tid").alias("tid"), F.min("w").alias("w"))
    unique = unique.filter("n = 1").groupBy("tid").agg(F.count("*").alias("ud"), F.sum("w").alias("uw"))
    total = F.aggregate("p.w", F.lit(0).cast("bigint"), lambda a, x: a + x)
    short = F.array_distinct(F.transform("p.h", lambda h: F.shiftright(h, 32).cast("int")))
    mass = held.select("tid", "bits", short.alias("h"), F.size("p.h").cast("double").alias("d"), total.cast("double").alias("n"))
    mass = mass.withColumn("lost", F.col("d") - F.size("h"))
    mass = mass.join(unique, "tid", "left").join(
        placed.groupBy("tid").agg(F.collect_set("band").alias("bands")), "tid"  # at most one for each band
    )
    mass = mass.withColumn("k", F.col("d") - F.coalesce("ud", F.lit(0)))
    mass = mass.withColumn("c", F.col("n") - F.coalesce("uw", F.lit(0))).drop("ud", "uw")
    words = [F.coalesce(F.col("bits")[i], F.lit(0)).alias(f"b{i}") for i in range(PARITY_WORDS)]
    inside = inside.join(mass, "tid").select("*", *words).drop("bits")
    one, other = (inside.select(*[F.col(c).alias(c + end) for c in inside.columns]) for end in ("_", "__"))

    least = threshold - 1e-9
    # p q / (p + q - p q) >= least, times n n'
    p, q = (F.least(F.col("c" + e), F.col("n" + e) - F.col("d" + e) + F.least("k_", "k__")) for e in ("_", "__"))
    possible = p * q * (1 + least) >= least * (p * F.col("n__") + q * F.col("n_"))
    # the same for p = (n - d + m) / n, solved for the d + d' - 2 m shingles of one side only
    over, excess = 1 + 1 / least, (F.col("n_") - F.col("d_")) - (F.col("n__") - F.col("d__"))
    skew = over * excess - (F.col("n_") - F.col("n__"))
    root = F.sqrt(skew * skew + 4 * F.col("n_") * F.col("n__"))
    most = ((F.col("n_") + F.col("n__")) / least - root) / over + 1e-6
    differ = functools.reduce(
        operator.add, (F.bit_count(F.col(f"b{i}_").bitwiseXOR(F.col(f"b{i}__"))) for i in range(PARITY_WORDS))
    )
    lowest = F.array_min(F.array_intersect("bands__", "bands_")) == F.col("band_")
    shared = F.size(F.array_intersect("h__", "h_")) + F.least("lost__", "lost_")
    close = one.filter("apart_").join(
        other,
        (F.col("band_") == F.col("band__"))
        & (F.col("label_") != F.col("label__"))
        & (~F.col("apart__") | (F.col("tid_") < F.col("tid__")))
        & possible
        & (differ <= most),
    )
    # no filter passes an observed metric
    close = close.observe(f"close_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("pairs"))
    pairs = close.filter(lowest & (F.col("d_") + F.col("d__") - 2 * shared <= most))
    pairs = pairs.select(F.least("tid_", "tid__").alias("hub"), F.greatest("tid_", "tid__").alias("tid")).distinct()
    done = known.select(F.least("hub", "tid").alias("x"), F.greatest("hub", "tid").alias("y"))
    new = pairs.join(done, (F.col("hub") == F.col("x")) & (F.col("tid") == F.col("y")), "left_anti")
    new = written(new, "pairs")
    discard(mixed, largest, placed, held)
    return new


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, kept. Rows with a missing text are a class
    of their own. Of rows equal in id and text, each carries the mark of the document."""
    found = classes(docs, threshold)
    named = docs.select("doc_id", _key(F.col("text")).alias("__t"), F.col("text").isNull().alias("__none"))
    found = found.select(F.col("doc_id").alias("__d"), "tid", "class_id", "first")
    on = common.same(F.col("doc_id"), F.col("__d")) & (F.col("__t") == F.col("tid")) & ~F.col("__none")
    joined = named.join(found, on, "left")
    return joined.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("first", F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """One document of each class, with the columns of ``docs``; of repeated rows one. Rows with a
    missing text all stay."""
    d, t = common.free_name(docs, "__d"), common.free_name(docs, "__t")
    keep = classes(docs, threshold).filter("first").select(F.col("doc_id").alias(d), F.col("tid").alias(t))
    on = common.same(F.col("doc_id"), F.col(d)) & (_key(F.col("text")) == F.col(t))
    filled = docs.filter(F.col("text").isNotNull()).join(keep, on)
    one = filled.dropDuplicates([d, t]).select(*docs.columns)
    return one.unionByName(docs.filter(F.col("text").isNull()))
