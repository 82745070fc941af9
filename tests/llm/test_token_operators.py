"""Packing, lexical search and alignment against brute force, and odd tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from answerproof.llm import alignment, ball_tree, common, packing, queries, sql, tokens

SMALL, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WEIRD = [
    "", " ", "  a  b ", "▁a", "a\x00b", "<s>x</s><unk>", "\n\t x", "ﬁ x\xa0y", "ééé", "﻿a", "<0x0A>",
    "a<|endoftext|>b <|endoftext|>", "日本語 текст \U0001f600\U0001f9d1‍\U0001f680", "x" * 5_000, " " * 5_000,
    "it's we'll I'd", "1234567890" * 30, "́́ combining é", "\r\n\r\n\v\f a", "ＡＢＣ ½ ² ⅷ",
]


def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))


def random_text(rng):
    alphabet = "ab c'sé\n\t1日́ ▁<|>.!ñ\U0001f600"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))


def test_quick_ids_equal_the_library():
    bpe, rng = tokens.byte_bpe(), random.Random(3)
    assert bpe.quick is not None
    marked, plain = library(), library()
    plain.encode_special_tokens = True
    every = [f"a{chr(c)}b1{chr(c)}2 {chr(c)} .{chr(c)}!" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text in [*WEIRD, *(random_text(rng) for _ in range(2_000)), *every]:
        assert bpe.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
        assert bpe.encode(text, special=True).tolist() == marked.encode(text, add_special_tokens=False).ids, text


def test_long_blank_texts_go_through_the_library():
    text = "a" + " " * (tokens.LONG_RUN + 5) + "b"
    want = library().encode(text, add_special_tokens=False).ids
    assert tokens.byte_bpe().encode(text).tolist() == want


# packing


def check_pieces(rows, texts, window):
    """Every id in one piece, sequences gapless, crc and counts right; texts by (doc_id, text) in any order."""
    bpe = library()
    want = Counter((i, tuple([*bpe.encode(t or "", add_special_tokens=False).ids, packing.END])) for i, t in texts)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    short = [s for s, held in by_sequence.items() if sum(r["length"] for r in held) < window]
    assert short in ([], [max(by_sequence, default=0)])
    # pieces in the order of the stream, put together to documents
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    got, i = Counter(), 0
    while i < len(stream):
        first, parts = stream[i], []
        assert first["start"] == 0
        done = 0
        while done < first["doc_tokens"]:
            r = stream[i]
            assert r["doc_id"] == first["doc_id"] and r["start"] == done and r["doc_tokens"] == first["doc_tokens"]
            parts.append((r["start"], r["length"], r["ids_crc32"]))
            done += r["length"]
            i += 1
        match = [k for k in want if k[0] == first["doc_id"] and len(k[1]) == done and all(
            zlib.crc32(np.array(k[1][s : s + n], "<u4").tobytes()) == crc for s, n, crc in parts)]
        assert match
        got[match[0]] += 1
    assert got == want


def test_packing_equals_brute_force(spark):
    rows = queries.op11_packing(spark, SMALL).collect()
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    check_pieces([r.asDict() for r in rows], [tuple(r) for r in docs], packing.WINDOW)


def test_packing_of_odd_rows_and_partitions(spark, odd, none):
    for docs in (odd, odd.repartition(11), odd.coalesce(1)):
        rows = packing.pack(docs, window=64).collect()
        check_pieces([r.asDict() for r in rows], [tuple(r) for r in docs.select("doc_id", "text").collect()], 64)
    assert packing.pack(none).count() == 0
    marked = spark.createDataFrame([(1, WEIRD[11]), (2, WEIRD[12])], "doc_id long, text string")
    check_pieces([r.asDict() for r in packing.pack(marked, 4).collect()], [tuple(r) for r in marked.collect()], 4)


def test_sequences_hold_the_stream(spark, odd):
    table = packing.placed(odd.repartition(5))
    stream = [i for r in table.orderBy("first").collect() for i in np.frombuffer(r["ids"], "<u2").tolist()]
    got = packing.sequences(table, 64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) == -(-len(stream) // 64)
    for r in got:
        assert r["ids"] == stream[r["sequence_id"] * 64 : (r["sequence_id"] + 1) * 64]


# lexical search


def brute_force_search(docs, items, k=20):
    """The contract word by word, on lists of (id, text)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, [t.translate(lower) for t in term.findall(text or "")]) for i, text in docs]
    bags = [(i, Counter(x), len(x)) for i, x in bags if x]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item_id, text in sorted(set(items), key=str):
        asked = [t.translate(lower) for t in term.findall(text or "")]
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in asked
                if t in bag
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, missing, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if missing else i, -score))
    return Counter(out)


def searched(docs, items, k=20):
    return Counter(tuple(r) for r in ball_tree.search(docs, items, k).collect())


def test_search_equals_brute_force(spark):
    docs, items = (common.table(spark, SMALL, t) for t in ("documents", "benchmark"))
    d = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    i = [tuple(r) for r in items.select("item_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_lexical_search(spark, SMALL).collect()) == brute_force_search(d, i)


@pytest.mark.parametrize("seed", range(3))
def test_search_with_ties_copies_and_small_trees(spark, monkeypatch, seed):
    monkeypatch.setattr(ball_tree, "BLOCK_QUERIES", 3)
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Ünï", "x1", "tail-end", "gamma", "DELTA"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    docs = [(rng.randrange(300), rng.choice(some)) for _ in range(400)] + [(None, some[0]), (7, None), (8, ""), (9, "-!")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for i in range(8)]
    items += [(8, None), (9, "..."), (10, "nowhere"), (3, "beta x1"), (None, "gamma"), items[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert searched(d, i, 5) == brute_force_search(docs, items, 5)


def test_search_of_odd_rows(spark, odd, none):
    items = odd.selectExpr("doc_id as item_id", "substring(text, 1, 300) as text", "n as rank", "k as score")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    assert searched(odd, items) == brute_force_search(docs, asked)
    assert ball_tree.search(none, items).count() == 0 and ball_tree.search(odd, none.selectExpr("doc_id as item_id", "text")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    width, places, values = 60, [], []
    for _ in range(1_000):
        p = rng.choice(width, rng.integers(1, 9), replace=False)
        places.append(p)
        values.append(rng.integers(1, 2_000_000_000, len(p)))
    places += [places[0]] * 300
    values += [values[0]] * 300
    tree = ball_tree.Tree(places, values, width)
    q = ball_tree.Queries([0, 1], {}, [np.array([1, 5, 9]), np.array([3])], [np.array([1, 2, 1]), np.array([4])])
    bounds = tree.bounds(q)
    leaves = 0
    for i in range(2):
        dense = np.zeros(width, np.int64)
        dense[q.places[i]] = q.counts[i]
        score = np.array([int(dense[p] @ v) for p, v in zip(places, values)])
        for node, (low, high) in enumerate(tree.span):
            assert score[tree.order[low:high]].max() <= bounds[node, i]
        leaves += sum(c is None for c in tree.children)
        best = []
        tree.search(bounds[:, i], dense, list(range(len(places))), best, 10, 1)
        want = sorted(((int(s), -d) for d, s in enumerate(score) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert sorted(tree.order.tolist()) == list(range(len(places))) and leaves > 20


def test_search_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{BIG}/{t}.parquet'")
    want = con.execute(sql.ORACLES["op12_lexical_search"]).fetchall()
    got = queries.op12_lexical_search(spark, BIG).select("item_id", "rank", "doc_id", "score").collect()
    assert Counter(tuple(r) for r in got) == Counter(want) and want


# alignment


def brute_force_alignment(docs):
    """Token by token, from the libraries' own ids."""
    a = library()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.PIECE_BPE))
    stand_for = tokens.byte_alphabet()
    out, links_of = [], []
    for i, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(stand_for[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = []
        for x in ids_b:
            piece = b.id_to_piece(x)
            hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            bytes_b.append(bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode())
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
        ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for high in both:
            groups.append((
                [x for x, e in zip(ids_a, ends_a) if low < e <= high], [x for x, e in zip(ids_b, ends_b) if low < e <= high]
            ))
            low = high
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append([i, len(ids_a), len(ids_b), len(groups), sum(links.values()), digest])
        links_of.append(links)
    count = Counter(pair for links in links_of for pair in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return Counter(
        (i, n_a, n_b, n_groups, n_links,
         sum(m for p, m in links.items() if count[p] == best[p[0]]),
         sum(m * count[p] for p, m in links.items()), digest)
        for (i, n_a, n_b, n_groups, n_links, digest), links in zip(out, links_of)
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_alignment_equals_brute_force(spark):
    docs = [tuple(r) for r in common.table(spark, SMALL, "documents").filter("length(text) < 6000").select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert aligned(alignment.align(df)) == brute_force_alignment(docs)


def test_alignment_of_weird_texts_in_small_blocks_and_steps(spark, monkeypatch):
    rng = random.Random(9)
    docs = list(enumerate([*WEIRD, *(random_text(rng) for _ in range(200)), *WEIRD, None]))
    want = brute_force_alignment(docs)
    for limit, step in ((1 << 22, 1 << 20), (300, 7), (5_000, 1)):
        monkeypatch.setattr(alignment, "STEP_LINKS", step)
        both = alignment.Pair(tokens.BYTE_BPE, tokens.PIECE_BPE)
        counts, kept, blocks = Counter(), [], []
        batch = [(i, t) for i, t in docs]
        size, part = 0, []
        for i, t in batch:
            part.append((i, t))
            size += len(t or "")
            if size > limit:
                blocks.append(part)
                size, part = 0, []
        blocks += [part] if part else []
        for block in blocks:
            b = both.block([t for _, t in block])
            for pair, holds in zip(b["pairs"].tolist(), b["holds"].tolist()):
                counts[pair] += holds
            kept.append((block, b))
        best = defaultdict(int)
        for pair, n in counts.items():
            best[pair >> 24] = max(best[pair >> 24], n)
        got = Counter()
        for block, b in kept:
            low = 0
            for j, (i, _) in enumerate(block):
                high = int(b["until"][j])
                held = [(int(b["pairs"][p]), int(m)) for p, m in zip(b["place"][low:high], b["many"][low:high])]
                low = high
                got[(i, *(int(b[c][j]) for c in alignment.FIGURES),
                     sum(m for p, m in held if counts[p] == best[p >> 24]),
                     sum(m * counts[p] for p, m in held), b["groups_sha256"][j])] += 1
        assert got == want
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert aligned(alignment.align(df)) == want


def test_alignment_of_odd_rows(odd, none):
    short = odd.filter("text is null or length(text) < 10000")
    assert aligned(alignment.align(short)) == brute_force_alignment([tuple(r) for r in short.select("doc_id", "text").collect()])
    assert alignment.align(odd).count() == odd.count()
    assert alignment.align(none).count() == 0


def test_alignment_in_steps_equals_one_step(monkeypatch):
    rng = random.Random(3)
    texts = [*WEIRD, *(random_text(rng) for _ in range(60)), None, "", *WEIRD]
    both = alignment.Pair(tokens.BYTE_BPE, tokens.PIECE_BPE)
    whole = both.block(texts)
    for size in (1, 50, 1_000):
        monkeypatch.setattr(alignment, "STEP_TOKENS", size)
        made = both.block(texts)
        assert made.keys() == whole.keys()
        assert all(np.array_equal(made[c], whole[c]) for c in whole)


def test_alignment_memory_does_not_grow_with_the_tokens_of_a_block(monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(600)]
    both = alignment.Pair(tokens.BYTE_BPE, tokens.PIECE_BPE)
    monkeypatch.setattr(alignment, "STEP_TOKENS", 1 << 14, raising=False)
    both.block(texts[:10])
    tracemalloc.start()
    n_tokens = int(sum(both.block(texts)[c].sum() for c in ("n_a", "n_b")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_tokens > 20 << 14
    assert peak < 64 * n_tokens
