"""Operators that compare documents, the mix, the archives and the pipeline."""

import gzip
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerproof import session
from answerproof.llm import common, fixity, line_runs, mixing, near_dups, queries, units

SMALL = "/root/testdata/sf0.001"


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- units ---------------------------------------------------------------------------------------


def units_by_hand(rows, min_words):
    """What is left of each text that loses something, from (id, text) without repeated rows."""
    first, found = {}, {}
    for doc_id, text in sorted(rows):
        for u in units.units(text):
            first.setdefault(u[4:], (doc_id, u[1]))
    for doc_id, text in rows:
        runs, last = [], None
        for i, start, end, words, *name in units.units(text):
            if first[tuple(name)] == (doc_id, start):
                continue
            if runs and last == i - 1:
                runs[-1][1], runs[-1][2] = end, runs[-1][2] + words
            else:
                runs.append([start, end, words])
            last = i
        spans = [(a, b) for a, b, words in runs if words >= min_words]
        if spans:
            found[doc_id] = ",".join(f"{a}:{b}" for a, b in spans)
    return found


def test_units_equal_brute_force(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op1_substring_dedup(spark, SMALL).collect()}
    assert {k: r["spans"] for k, r in got.items()} == units_by_hand(rows, units.MIN_WORDS)
    for doc_id, text in rows:
        if doc_id in got:
            spans = [tuple(map(int, s.split(":"))) for s in got[doc_id]["spans"].split(",")]
            cut = set().union(*(range(a, b) for a, b in spans))
            assert got[doc_id]["text"] == "".join(c for i, c in enumerate(text) if i not in cut)
            assert got[doc_id]["removed"] == len(cut)


def test_units_do_not_depend_on_what_stands_before():
    passage = "This sentence has a number of words. Short. And this one follows it closely indeed."
    a = {u[4] for u in units.units(f"Something else before the cut {passage} after")}
    b = {u[4] for u in units.units(f"Completely different words. More {passage} end")}
    assert len(a & b) >= 1
    for kind in units.ENDS:
        pieces = units.units(f"a b\n\nc d. e f\n{passage}", kind)
        assert all(x[1] < x[2] for x in pieces) and [x[0] for x in pieces] == list(range(len(pieces)))


def test_units_of_odd_rows(odd, none):
    got = {r["doc_id"]: r["removed"] for r in units.dedup_units(odd, "line").collect()}
    # the earliest copy stays, a repeated row shares its document's fate, a missing id ranks first
    assert 10 in got and 9 not in got and 2 in got and 1 not in got and 3 not in got
    assert units.dedup_units(none).count() == 0


def test_passages_pasted_into_sentences_are_cut_whole(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows, want, size = [], {}, units.MIN_WORDS
    for n in (size - 1, size, size + 1, 40, 51, 100):
        # sentences of odd lengths inside, none of them at the ends
        words = draw(n)
        passage = " ".join(w + "." if rng.random() < 0.1 and 0 < i < n - 1 else w for i, w in enumerate(words))
        i = len(rows)
        rows.append((i, f"{' '.join(draw(7))} {passage} {' '.join(draw(9))}."))
        before = f"{' '.join(draw(3))}. {' '.join(draw(2))} "
        rows.append((i + 1, f"{before}{passage.upper()} {' '.join(draw(30))}"))
        if n >= size:
            want[i + 1] = f"{len(before)}:{len(before) + len(passage)}"
    got = units.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages_equal_brute_force(spark, seed):
    """Few words, so that passages overlap themselves and each other."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["a", "b", "İc"], rng.integers(0, 60), p=[0.6, 0.3, 0.1])) for _ in range(12)]
    texts += [f"{a[: len(a) // 2]} {b[len(b) // 3 :]}" for a, b in zip(texts, texts[1:])]
    rows, size = list(enumerate(texts)), 10
    first, want = {}, {}
    for doc_id, text in rows:
        places = [m.span() for m in re.finditer(r"\w+", text)]
        words = [text[a:b] for a, b in places]
        later = [i for i in range(len(words) - size + 1) if first.setdefault(tuple(words[i : i + size]), (doc_id, i)) != (doc_id, i)]
        if later:
            gone = set().union(*(range(places[i][0], places[i + size - 1][1]) for i in later))
            want[doc_id] = "".join(c for i, c in enumerate(text) if i not in gone)
    got = units.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), min_words=size).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and want


# --- lines ---------------------------------------------------------------------------------------


def lines_by_hand(rows, min_words):
    """Line numbers that go, from (id, text): every run with enough words that occurs earlier."""
    texts = {}
    for doc_id, text in rows:
        kept = [(i, x.strip(" \t\v\f\r")) for i, x in enumerate(text.split("\n"))]
        texts[doc_id] = [(i, x, len(re.split(r"[ \t\v\f\r]+", x))) for i, x in kept if x]
    first = {}
    for doc_id in sorted(texts):
        lines = texts[doc_id]
        for a in range(len(lines)):
            for b in range(a + 1, min(len(lines), a + min_words) + 1):
                first.setdefault(tuple(x for _, x, _ in lines[a:b]), (doc_id, a))
    gone = defaultdict(set)
    for doc_id, lines in texts.items():
        for a in range(len(lines)):
            for b in range(a + 1, min(len(lines), a + min_words) + 1):
                words = [w for _, _, w in lines[a:b]]
                # shortest runs from a start or to an end cover all longer ones
                if sum(words) < min_words or (sum(words[:-1]) >= min_words and sum(words[1:]) >= min_words):
                    continue
                where = first[tuple(x for _, x, _ in lines[a:b])]
                if where != (doc_id, a):
                    low = max(a, where[1] + b - a) if where[0] == doc_id else a
                    gone[doc_id] |= {lines[i][0] for i in range(low, b)}
    return {k: sorted(v) for k, v in gone.items() if v}


def test_lines_equal_brute_force(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    want = lines_by_hand(rows, line_runs.MIN_WORDS)
    got = {r["doc_id"]: r for r in queries.op9_line_dedup(spark, SMALL).collect()}
    assert len(got) == len(rows)
    assert {k: r["removed"] for k, r in got.items() if r["removed"]} == {k: ",".join(map(str, v)) for k, v in want.items()}
    for doc_id, text in rows:
        left = [x for i, x in enumerate(text.split("\n")) if i not in want.get(doc_id, [])]
        assert got[doc_id]["text"] == "\n".join(left)


def test_single_repeated_lines_are_cut(spark):
    """Boilerplate of a few words that stands alone between unique lines."""
    rows = [(i, f"own opening line of number {i}\n All rights reserved by us.\nown last line of number {i}\nYes.") for i in range(30)]
    got = {r["doc_id"]: r["removed"] for r in line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [1] if i else [] for i in range(30)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    lines = ["a b c", "d", "e f", "", "g h i j k"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for i in range(25)]
    got = line_runs.later_copies(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert {r["d"]: r["lines"] for r in got} == lines_by_hand(rows, 6)


def test_lines_of_odd_rows(odd, none):
    got = line_runs.dedup_lines(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and got.columns == [*odd.columns, "kept_text", "removed_"]
    cut = {r["doc_id"]: r["removed_"] for r in rows}
    assert cut[9] == [] and cut[10] == [1] and cut[4] == [] and cut[5] == []
    assert cut[1] == [] and cut[2] == [0]
    assert all(r["kept_text"] is None for r in rows if r["text"] is None)
    assert line_runs.dedup_lines(none).count() == 0


def test_ranks_are_a_suffix_array(spark):
    """Equal exactly for equal runs, and in the order of the line numbers."""
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(rng.choice(["x y", "z", "q r s"], 9))) for i in range(12)]
    active, levels = line_runs.suffix_ranks(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    table = {(r["d"], r["pos"]): r for r in active.collect()}
    for level in range(levels):
        runs = {}
        for (d, p), r in table.items():
            if r[f"r{level}"] is not None:
                runs[tuple(table[d, p + j]["r0"] for j in range(2**level))] = r[f"r{level}"]
        assert [runs[k] for k in sorted(runs)] == sorted(set(runs.values()))


# --- near duplicates -----------------------------------------------------------------------------


def exact_similarity(a, b):
    a, b = Counter(a.tolist()), Counter(b.tolist())
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def test_similarity_and_its_estimate():
    rng = np.random.default_rng(2)
    for _ in range(5):
        x = rng.choice([f"w{i}" for i in range(30)], 120)
        y = x.copy()
        y[rng.integers(0, 120, 9)] = "new"
        texts = [" ".join(x), " ".join(y)]
        owner, shingle, weight = near_dups.weigh(texts)
        table = near_dups.signatures(owner, shingle, weight, 2, 4096)
        want = exact_similarity(near_dups.shingles(texts[0]), near_dups.shingles(texts[1]))
        sides = [(shingle[owner == i], weight[owner == i]) for i in (0, 1)]
        assert abs(near_dups.similarity(*sides[0], *sides[1]) - want) < 1e-12
        assert abs((table[0] == table[1]).mean() - want) < 0.04


def test_classes_equal_brute_force(spark):
    """Families of edited copies around the threshold, against components over all pairs."""
    rng = np.random.default_rng(7)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(150)]
        for copy in range(9):
            words = list(base)
            for at in rng.choice(150, copy % 5, replace=False):
                words[at] = f"c{copy}x{at}"
            rows.append((len(rows), " ".join(words)))
    parts = [near_dups.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if exact_similarity(parts[i], parts[j]) >= near_dups.SIMILAR:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in range(len(rows))}
    assert {r["doc_id"] for r in got if r["kept"]} == {find(i) for i in range(len(rows))}


def test_components_of_chains_and_stars(spark):
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(40)] + [("z", f"s{i}") for i in range(20)] + [("q", "q")]
    got = near_dups.components(spark.createDataFrame(edges, "u string, v string")).collect()
    assert {r["label"] for r in got if r["node"].startswith("a")} == {"a000"}
    assert {r["label"] for r in got if r["node"][0] in "sz"} == {"s0"} and len(got) == 41 + 21


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    classes = defaultdict(set)
    for r in got:
        classes[r["doc_id"]].add(r["class_id"])
    assert classes[1] == classes[2] == classes[3] == {1} and classes[5] == classes[6] == {5}
    assert classes[4] == {4} and classes[8] == {8} and classes[9] == {9} and classes[7] == {7}
    left = near_dups.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    kept = Counter(r["doc_id"] for r in left.collect())
    assert kept == Counter({1: 1, 4: 2, 5: 1, 7: 1, None: 1, 8: 1, 9: 1, 11: 1})
    assert near_dups.near_duplicates(none).count() == 0


# --- mix -----------------------------------------------------------------------------------------


def rounds_by_hand(sizes, weights):
    """Source of every slot by a plain simulation, round by round."""
    out, done = [], Counter()
    while any(done[s] < n for s, n in sizes.items()):
        share = {s: min(weights[s], sizes[s] - done[s]) for s in sorted(sizes) if done[s] < sizes[s]}
        total, given = sum(share.values()), Counter()
        for t in range(total):
            ready = [s for s, w in share.items() if given[s] < w and given[s] * total // w <= t]
            due = {s: -(-(given[s] + 1) * total // share[s]) for s in ready}
            best = min(sorted(ready), key=lambda s: due[s])
            assert due[best] > t  # no deadline is missed
            out.append(best)
            given[best] += 1
        done.update(given)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_equals_simulation(spark, seed):
    rng = np.random.default_rng(seed)
    weights = {f"s{i}": int(rng.integers(1, 6)) for i in range(5)}
    rows = {s: int(rng.integers(1, 90)) for s in weights}
    docs = [(i, s) for i, s in enumerate(s for s, n in rows.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string"), weights, block_rows=4).collect()
    blocks = {s: -(-n // 4) for s, n in rows.items()}
    want = rounds_by_hand(blocks, weights)
    slots = {r["slot"]: r["source"] for r in got}
    assert [slots[i] for i in range(len(want))] == want
    assert sorted(r["position"] for r in got) == list(range(len(docs)))
    assert [r["slot"] for r in sorted(got, key=lambda r: r["position"])] == sorted(r["slot"] for r in got)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    # less than one block away from the exact share, as long as no source has ended
    total, ended = sum(weights.values()), min(blocks[s] // weights[s] for s in weights) * sum(weights.values())
    seen = Counter()
    for t, s in enumerate(want[:ended], 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * w / total) < 1 for x, w in weights.items())


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd, {"a": 2, None: 1}, block_rows=2)
    rows = got.collect()
    assert got.columns[: len(odd.columns)] == odd.columns and "slot_" in got.columns
    assert sorted(r["position_"] for r in rows) == list(range(odd.count()))
    assert mixing.mix(none, {"a": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": mixing.MAX_SLOTS})


# --- archives ------------------------------------------------------------------------------------


def test_audit_finds_exactly_the_worn_records(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    left, right = fixity.archived(pages, 3), fixity.archived(queries.second_copy(pages), 3)
    worn = left.join(right.select("record", F.col("digest").alias("other")), "record").filter("digest != other")
    want = {str(r["record"]) for r in worn.collect()}
    got = fixity.audit(left, right).collect()
    assert {r["record"] for r in got if r["what"] == "record"} == want and want
    roots = {r["archive"]: r["same"] for r in got if r["what"] == "root"}
    assert len(roots) == 3
    assert {a for a, same in roots.items() if not same} == {r["archive"] for r in got if r["what"] == "record"}


def test_audit_of_odd_tables(spark):
    rows = [(1, "u", "x" * 50), (2, None, None), (None, "v", ""), (2, "w", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    left = fixity.archived(pages, 1)
    assert all(r["same"] for r in fixity.audit(left, left).collect())
    gone = left.filter("record != 1 or record is null")
    lost = fixity.audit(left, gone).collect()
    assert any(r["what"] == "record" and r["right"] is None for r in lost)
    empty = fixity.archived(pages.limit(0))
    assert fixity.audit(empty, empty).count() == 0
    assert {r["what"] for r in fixity.audit(left, empty).collect()} == {"root", "record"}


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_round_trip(spark, tmp_path, packed):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = [bytes(r[0]) for r in pages.orderBy("page_id").select(fixity.warc_record()).collect()]
    for name in ("one.warc", "two.warc"):
        fixity.write_warc_file(str(tmp_path / name), records[: 30 if name < "p" else 50], packed)
    read = fixity.read_warc(spark, str(tmp_path / "*.warc"))
    rows = read.filter(F.col("archive").endswith("one.warc")).orderBy("offset").collect()
    assert len(rows) == 30 and all(r["record"].startswith("<urn:md5:") for r in rows)
    assert all(b["offset"] == a["offset"] + a["length"] for a, b in zip(rows, rows[1:]))
    assert all(r["same"] for r in fixity.audit(read, read).collect())


def forty(spark, middle="é", gone=None):
    """Records of 40 pages in one archive; the fourth one has ``middle`` in its text."""
    rows = [(i, f"u{i}", "page " * i + (middle if i == 3 else "é")) for i in range(40) if i != gone]
    return fixity.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), 1)


def statuses(found):
    return sorted((r["status"], r["record"]) for r in found.collect() if r["what"] == "record")


def test_a_record_of_another_length_is_one_change(spark):
    found = fixity.audit(forty(spark), forty(spark, "e")).cache()
    kinds = statuses(found)
    assert [r for kind, r in kinds if kind == "changed"] == ["3"]
    assert len(kinds) == 37 and sum(kind == "shifted" for kind, _ in kinds) == 36
    assert {r["moved"] for r in found.collect() if r["status"] == "shifted"} == {-1}


def test_runs_of_shifted_records_are_one_row(spark):
    found = fixity.audit(forty(spark), forty(spark, "e")).cache()
    folded = [r for r in fixity.fold_shifted(found).collect() if r["what"] == "record"]
    assert sorted((r["status"], r["record"], r["records"]) for r in folded) == [("changed", "3", 1), ("shifted", "4", 36)]
    last = max(r["end"] for r in found.collect())
    assert {r["end"] for r in folded if r["status"] == "shifted"} == {last}
    assert fixity.fold_shifted(found.filter("what = 'root'")).count() == 1


def test_a_lost_record_is_missing_or_added(spark):
    kinds = statuses(fixity.audit(forty(spark), forty(spark, gone=20)))
    assert [r for kind, r in kinds if kind == "missing"] == ["20"]
    assert {kind for kind, _ in kinds} == {"missing", "shifted"} and len(kinds) == 20
    kinds = statuses(fixity.audit(forty(spark, gone=20), forty(spark)))
    assert [r for kind, r in kinds if kind == "added"] == ["20"]


def test_repeated_records_are_matched_by_their_order(spark):
    rows = [(0, 0, 10, "same"), (1, 10, 10, "same"), (2, 20, 10, "same"), (3, 30, 10, "other")]
    table = spark.createDataFrame([(0, str(r), a, n, d) for r, a, n, d in rows], "archive int, record string, offset long, length long, digest string")
    shorter = table.filter("record != '1'").withColumn("offset", F.expr("case when offset > 10 then offset - 10 else offset end"))
    # leaves are places and contents, so the second of the equal records still stands where one stood
    assert statuses(fixity.audit(table, shorter)) == [("missing", "2"), ("shifted", "3")]


def whole(n):
    body = f"body {n} ".encode() * 20
    return b"WARC/1.1\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body)) + body + b"\r\n\r\n"


def ranges(data):
    found = list(fixity._records(data))
    assert sum(size for _, size, _ in found) == len(data)
    assert all(at + size == then for (at, size, _), (then, _, _) in zip(found, found[1:]))
    return [None if head is None else fixity._NAME.search(head)[1].decode() for _, _, head in found]


def test_damaged_archives_are_ranges_of_their_own():
    a, b, c = whole(0), whole(1), whole(2)
    assert ranges(b"") == []
    assert ranges(a + b + c) == ["<r0>", "<r1>", "<r2>"]
    assert ranges(b"garbage" + a + b) == [None, "<r0>", "<r1>"]
    assert ranges(a + b.replace(b"Content-Length", b"Content-Lenght") + c) == ["<r0>", None, "<r2>"]
    assert ranges(a + b[:30] + c) == ["<r0>", None, "<r2>"]  # a cut header
    assert ranges(a + b[:-40] + c) == ["<r0>", None, "<r2>"]  # a cut body
    assert ranges(a + b[:-40]) == ["<r0>", None]
    assert ranges(a + c[:20]) == ["<r0>", None]
    packed = [gzip.compress(r) for r in (a, b, c)]
    assert ranges(b"".join(packed)) == ["<r0>", "<r1>", "<r2>"]
    worn = bytearray(packed[1])
    worn[len(worn) // 2] ^= 0xFF
    assert ranges(packed[0] + bytes(worn) + packed[2]) == ["<r0>", None, "<r2>"]
    assert ranges(packed[0] + packed[1][:-9]) == ["<r0>", None]
    assert ranges(packed[0] + b"junk" + packed[2]) == ["<r0>", None, "<r2>"]


def test_long_and_hostile_archives_take_linear_time():
    many = gzip.compress(whole(1)) * 20_000
    began = time.perf_counter()
    assert len(list(fixity._records(many))) == 20_000
    assert list(fixity._records(b"WARC/1.0\r\n" * 100_000)) == [(0, 1_000_000, None)]
    assert time.perf_counter() - began < 20


def test_damaged_files_are_audited(spark, tmp_path):
    (tmp_path / "left").mkdir(), (tmp_path / "right").mkdir()
    records = [whole(i) for i in range(30)]
    (tmp_path / "left" / "x.warc").write_bytes(b"".join(records))
    records[7] = records[7][:25]
    (tmp_path / "right" / "x.warc").write_bytes(b"".join(records))
    left, right = (
        fixity.read_warc(spark, str(tmp_path / side)).withColumn("archive", F.substring_index("archive", "/", -1))
        for side in ("left", "right")
    )
    assert left.filter("damaged").count() == 0 and right.filter("damaged").count() == 1
    found = fixity.audit(left, right).filter("status in ('missing', 'added')").collect()
    assert sorted((r["status"], r["record"]) for r in found) == [("added", None), ("missing", "<r7>")]


# --- pipeline ------------------------------------------------------------------------------------


def test_stages_take_effect(spark):
    docs = common.table(spark, SMALL, "documents")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        sizes.append(out.count())
        if name != "mixing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "line dedup":
            assert out.filter(F.length("text") != F.col("n_chars")).count() == docs.filter(F.length("text") != F.col("n_chars")).count()
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert sorted(r["position"] for r in docs.collect()) == list(range(sizes[-1]))


def test_run_is_the_stages_in_order_and_keeps_only_their_results(spark):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.filter("position is null").count() == 0 and out.select("doc_id").distinct().count() == out.count()
    new = [name for name in os.listdir(folder) if name not in before]
    assert len(new) == 1 and new[0].startswith("corpus-")
    assert len(os.listdir(f"{folder}/{new[0]}")) == len(corpus_pipeline.STAGES)


def test_the_two_halves_of_a_line_digest_are_independent(spark):
    from answerproof.llm import line_runs

    docs = spark.createDataFrame([(1, "first line\nsecond line\nthird")], "doc_id long, text string")
    rows = line_runs.lines_of(docs).collect()
    # a half that is made out of the other one adds nothing to it
    of_half = spark.createDataFrame([(r["h1"],) for r in rows], "h1 long")
    made = {r[0] for r in of_half.selectExpr("xxhash64(1, h1)").collect()}
    seeded = {r["h2"] for r in rows}
    assert len(seeded) == 3 and not made & seeded
    chained = {r[0] for r in docs.selectExpr("explode(split(text, '\n')) as t").selectExpr("xxhash64(t, 1)").collect()}
    assert not chained & seeded


def test_components_of_chains_cycles_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    cycle = [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    star = [(299, 200 + i) for i in range(20)]
    rows = chain + cycle + star + [(5, 5), (1, 0)]
    got = near_dups.components(spark.createDataFrame(rows, "u long, v long")).collect()
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(7)}, **{200 + i: 200 for i in range(20)}, 299: 200}
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
    assert near_dups.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_names_the_operators_use_themselves_may_be_taken(spark):
    rows = [(1, "one two three four five\nrest of one"), (2, "one two three four five\nother rest of two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("__d", "__k", "__t", "__lines", "__id", "__y", "__h", "tid", "d", "k")})
    cut = line_runs.dedup_lines(docs).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in cut] == [rows[0][1], "other rest of two"]
    assert all(r["__d"] == r["__k"] == r["__lines"] == 1 for r in cut)
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 2


def test_only_texts_that_are_needed_are_shuffled_for_their_profiles(spark, monkeypatch):
    rows = [(i, f"text number {i} has words of its own and some of all") for i in range(400)]
    rows += [(None, "nobody's words"), (3, None), (7, rows[7][1]), (500, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.filter("doc_id % 40 = 7 or (doc_id is null)").filter("text is not null")
    needed = session.written(wanted.select(near_dups._key(F.col("text")).alias("tid")).distinct())
    named = docs.select("doc_id", "text", near_dups._key(F.col("text")).alias("tid"))
    found = {r.doc_id for r in near_dups._marked(named, needed, "tid").collect()}
    assert {None, 500, *range(7, 400, 40)} <= found and len(found) < 20

    def profiles():
        return sorted((bytes(r.tid), r.p.h, r.p.w) for r in near_dups._profiles(docs, needed).collect())

    some = profiles()
    monkeypatch.setattr(near_dups, "MARK_WORDS", 1)  # every bit is set sooner or later
    assert profiles() == some and len(some) == 11
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = near_dups._profiles(docs, needed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = re.findall(r"(SortMergeJoin|BroadcastHashJoin).*LeftSemi", plan)
    assert joins == ["SortMergeJoin", "BroadcastHashJoin"]  # the lower one stands last


def test_parities_bound_the_shingles_of_one_side():
    rng = np.random.default_rng(3)
    for shared, more in ((0, 5), (300, 0), (300, 40), (4000, 900)):
        both, *own = (rng.integers(-(2**63), 2**63 - 1, n) for n in (shared, more, more))
        x, y = (near_dups.parities(np.concatenate([both, side])) for side in own)
        differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert len(x) == near_dups.PARITY_WORDS and differ <= 2 * more and differ % 2 == 0
        assert more > 100 or differ >= 1.8 * more


def test_pairs_of_a_large_family_meet_without_their_lists(spark, monkeypatch):
    """Copies around the threshold, with one word put in, so that a changed shingle is in several."""
    rng = np.random.default_rng(11)
    rows = []
    for copy in range(260):
        words = [f"w{i}" for i in range(300)]
        for at in rng.choice(300, 4 + copy % 7, replace=False):
            words[at] = "that"
        rows.append((copy, " ".join(words)))
    sides = [near_dups.weigh([t])[1:] for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dups.similarity(*sides[i], *sides[j]) >= near_dups.SIMILAR:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    pairs, keep = [], near_dups.written

    def written(df, name):
        pairs.extend([df] if name == "pairs" else [])
        return keep(df, name)

    monkeypatch.setattr(near_dups, "written", written)
    monkeypatch.setattr(near_dups, "discard", lambda *tables: None)  # the plan runs once more
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in range(len(rows))}
    assert 100 < len({find(i) for i in range(len(rows))}) < 250

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = pairs[-1].select("*")
        run = again._jdf.queryExecution()
        code = spark._jvm.PythonSQLUtils.explainString(run, "codegen")
        again.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    joins = [n for n in nodes(run.executedPlan()) if n.nodeName() == "SortMergeJoin"]
    meet = [n for n in joins if "tid_" in n.toString().split("\n")[0]]
    assert len(meet) == 1 and "array_intersect" not in meet[0].toString().split("\n")[0]
    assert meet[0].metrics().apply("numOutputRows").value() < 1000  # of 33,670 pairs in up to 32 bands
    # the JVM compiles no method of more than 8,000 bytes
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
