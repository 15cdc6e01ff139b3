"""Packing, splitting, encoding, leakage and shared spans against brute force."""

from __future__ import annotations

import base64
import itertools
import random

import pytest

pytest.importorskip("codeloom.llm")

from codeloom.llm import bpe, fmindex, leakage, packing, shared_spans, splitting  # noqa: E402


# ---- encoding


def public_encoding():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_public_library_on_documents(spark, tiny):
    ref = public_encoding()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: list(r.ids) for r in bpe.encode_column(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id", "text").collect()}
    assert got.keys() == docs.keys()
    assert all(got[d] == (ref.encode_ordinary(t) if t else []) for d, t in docs.items())


def test_bpe_edge_texts():
    ref, enc = public_encoding(), bpe.encoder()
    rng = random.Random(3)
    texts = ["", " ", "\n\n  x", "a" * 5000, "é́👩‍💻 ​﻿漢字", "don't <|endoftext|>", "\r\n\r\n", "ab" * 999 + " z"]
    texts += ["".join(chr(rng.choice([32, 10, 65, 97, 0x4E00, 0x1F600, 0x301])) for _ in range(200)) for _ in range(30)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert enc.decode(ids) == t
    assert enc.encode(None) == []


def test_decode_round_trip(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None), (3, ""), (4, "ä\t\n")], "doc_id bigint, text string")
    ids = bpe.encode_column(df, "doc_id", "text")
    back = {r.doc_id: r.text for r in bpe.decode_column(ids, "doc_id", "ids").collect()}
    assert back == {1: "x y", 2: "", 3: "", 4: "ä\t\n"}


# ---- packing


@pytest.mark.parametrize("refined", [False, True])
def test_patterns_hold_every_length_once(refined):
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.randrange(1, 60)
        hist = {rng.randrange(1, cap + 1): rng.randrange(1, 30) for _ in range(rng.randrange(0, 12))}
        seen: dict[int, int] = {}
        for count, lengths in packing.pack_histogram(hist, cap, refined):
            assert sum(lengths) <= cap and count > 0
            for x in lengths:
                seen[x] = seen.get(x, 0) + count
        assert seen == hist


def best_fit(lengths, cap):
    """Containers of the classical best fit, longest first, item by item."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(cap - x)
    return len(rooms)


def test_patterns_use_no_more_than_best_fit():
    """The least by volume is no bound that any packing reaches; best fit is within 11/9 of the optimum."""
    rng = random.Random(6)
    for _ in range(150):
        cap = rng.choice([20, 100, 256])
        hist = {rng.randrange(1, cap + 1): rng.randrange(1, 9) for _ in range(20)}
        used = sum(c for c, _ in packing.pack_histogram(hist, cap))
        lengths = [k for k, v in hist.items() for _ in range(v)]
        assert used <= best_fit(lengths, cap)


def shortest_first(lengths, cap):
    """Containers of the plain rule, item by item: into the emptiest that has room."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        if rooms and max(rooms) >= x:
            r = max(rooms)
            rooms.remove(r)
            rooms.append(r - x)
        else:
            rooms.append(cap - x)
    return len(rooms)


def test_the_plain_placement_is_shortest_pack_first():
    rng = random.Random(16)
    for _ in range(150):
        cap = rng.choice([20, 100, 256])
        hist = {rng.randrange(1, cap + 1): rng.randrange(1, 9) for _ in range(12)}
        plain = packing.place(hist, cap)
        assert sum(c for c, _ in plain) == shortest_first([k for k, v in hist.items() for _ in range(v)], cap)
        assert sum(c for c, _ in packing.pack_histogram(hist, cap)) <= sum(c for c, _ in plain)


def test_a_hot_length_is_ranked_in_salts(spark):
    items = [(1, f"f{i}", None, None, "x" * rng, 1) for i, rng in enumerate([20] * 400 + list(range(4, 84, 4)) * 3)]
    df = spark.createDataFrame(items, ITEMS)
    budgets = spark.createDataFrame([(1, 20)], "task_id bigint, limit_tokens bigint")
    for salt_rows in (10**6, 2):
        rows = packing.pack(df, budgets, salt_rows=salt_rows).collect()
        check_packing(rows)
        assert len(rows) == len(items) and all(r.container is not None for r in rows)


ITEMS = "task_id bigint, relative_path string, score double, reasons array<string>, snippet string, extra int"


def check_packing(rows):
    by_box: dict = {}
    for r in rows:
        if r.container is not None:
            by_box[(r.task_id, r.container)] = by_box.get((r.task_id, r.container), 0) + r.tokens
            assert by_box[(r.task_id, r.container)] <= r.limit_tokens
        if r.piece_no > 0 or r.end_byte < len((r.snippet or "").encode()):
            assert -(-len(r.snippet.encode()) // 4) > r.limit_tokens


def test_packing_of_rows(spark):
    rng = random.Random(7)
    items = [(1, f"f{i % 40}", rng.choice([None, 1.0, 2.0]), ["r"], rng.choice([None, "", "x" * rng.randrange(1, 90), "é" * 150]), 1) for i in range(300)]
    items += items[:50] + [(2, "a", 1.0, None, "abc", 2), (3, "a", None, None, None, 2), (4, "a", 0.0, [], "zz", 1), (None, "a", 1.0, [], "q", 1)]
    budgets = [(1, "r", "t", 20), (3, "r", "t", 5), (4, "r", "t", 0)]
    out = packing.pack(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(budgets, "task_id bigint, repo_id string, task_text string, limit_tokens bigint")
    ).collect()
    check_packing(out)
    distinct = {(t, p, s, tuple(r) if r is not None else None, x) for t, p, s, r, x, _ in items}
    got = {}
    for r in out:
        got.setdefault((r.task_id, r.relative_path, r.score, tuple(r.reasons) if r.reasons is not None else None, r.snippet), []).append(r)
    assert set(got) == distinct
    for key, rows in got.items():
        data = (key[4] or "").encode()
        assert b"".join(data[r.start_byte : r.end_byte] for r in sorted(rows, key=lambda r: r.piece_no)) == data
    assert all(r.container is None for r in out if r.task_id in (2, 4, None))
    assert [r.container for r in out if r.task_id == 3] == [0]


def test_packing_of_empty_tables(spark):
    out = packing.pack(spark.createDataFrame([], ITEMS), spark.createDataFrame([], "task_id bigint, limit_tokens bigint"))
    assert out.count() == 0


def test_packing_of_test_tables(spark, tiny):
    items, budgets = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("scored_files", "budgets"))
    out = packing.pack(items, budgets)
    rows = out.collect()
    check_packing(rows)
    assert out.select("task_id", "relative_path", "score", "reasons", "snippet").distinct().count() == items.distinct().count()


# ---- splitting


def check_split(text, limit, overlap):
    data = text.encode()
    cuts = splitting.split(text, limit, overlap)
    if len(data) <= limit:
        assert cuts == []
        return cuts
    assert cuts[0][1] == 0 and cuts[-1][2] == len(data)
    for (h, lo, hi), nxt in itertools.zip_longest(cuts, cuts[1:]):
        assert h <= lo < hi and hi - h <= max(4, limit)
        data[h:hi].decode()
        if nxt:
            assert nxt[1] == hi
            assert nxt[0] >= hi - overlap
    assert b"".join(data[lo:hi] for _, lo, hi in cuts) == data
    return cuts


def test_split_round_trip_and_limits():
    rng = random.Random(8)
    alphabet = ["a", "b ", "word ", "\r\n", "\n", "\n\n", ". ", "é", "漢", "👩‍💻", "é", "。"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400)))
        check_split(text, rng.randrange(1, 200), rng.randrange(0, 60))
    check_split("x" * 10_000, 1024, 100)
    check_split("漢" * 5_000, 1024, 256)
    check_split("\r\n" * 3_000, 1024, 64)


def test_split_prefers_topic_borders():
    one = "the cat purrs and the cat sleeps on a warm mat\n" * 12
    two = "stocks fell as bond yields rose in early trading\n" * 12
    cuts = check_split(one + two, 800, 0)
    assert len(one) in [c[2] for c in cuts]


def test_split_takes_the_deepest_valley_not_the_first_empty_line():
    one = "the cat purrs and the cat sleeps on a warm mat\n"
    two = "stocks fell as bond yields rose in early trading\n"
    text = one * 10 + "\n" + one * 3 + two * 14
    cuts = check_split(text, 800, 0)
    assert len(one * 13) + 1 in [c[2] for c in cuts]  # a plain line end where the topic changes
    assert len(one * 10) + 1 not in [c[2] for c in cuts]


@pytest.mark.parametrize("overlap", [600, 1000, 1020, 5000])
def test_overlap_is_given_in_full(overlap):
    cuts = check_split("abcdefghi\n" * 300, 1024, overlap)
    assert all(lo - h == min(overlap, 1020, lo) for h, lo, _ in cuts)


def test_split_keeps_clusters_whole():
    text = "é\r\n" * 400
    for _, _, hi in check_split(text, 100, 10)[:-1]:
        before, after = text.encode()[:hi].decode(), text.encode()[hi:].decode()
        assert not (before.endswith("\r") and after.startswith("\n")) and not after.startswith("́")


def test_pieces_of_tables(spark):
    d = [("a", "r1", "x" * 3000, 5), ("a", "r1", "x" * 3000, 5), ("b", "r1", "y", 5), ("c", "r2", None, 5), ("d", None, "z" * 4000, 5), ("e", "r1", "", 1)]
    config = spark.createDataFrame([("r1", 1, 100), ("r2", None, 64)], "repo_id string, max_file_size_kb bigint, overlap_bytes bigint")
    out = splitting.pieces(spark.createDataFrame(d, "id string, repo_id string, content string, extra int"), config).collect()
    assert {r.id for r in out} == {"a"}
    a = sorted(out, key=lambda r: r.piece_no)
    assert "".join(r.content[r.start_byte - r.from_byte :] for r in a) == "x" * 3000
    assert all(len(r.content.encode()) <= 1024 and r.n_pieces == len(a) for r in a)


def test_one_id_in_two_repositories_and_with_two_contents(spark):
    d = [("a", "r1", "x" * 3000), ("a", "r2", "y" * 2500), ("a", "r2", "z" * 2500), ("a", None, "q" * 2100 * 1024)]
    config = spark.createDataFrame([("r1", 1, 1023), ("r2", 1, 0)], "repo_id string, max_file_size_kb bigint, overlap_bytes bigint")
    out = splitting.pieces(spark.createDataFrame(d, "id string, repo_id string, content string"), config).collect()
    whole: dict = {}
    for r in sorted(out, key=lambda r: r.piece_no):
        whole.setdefault((r.repo_id, r.content_hash), []).append(r.content.encode()[r.start_byte - r.from_byte :])
    assert sorted((k[0] or "", b"".join(v).decode()) for k, v in whole.items()) == sorted((r or "", t) for _, r, t in d)
    assert {r.repo_id for r in out if r.overlap_short} == {"r1"}


# ---- leakage


def brute_leaks(docs, items, n):
    out = set()
    for i, it in items:
        w = leakage.words(it)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, text in docs:
            v = leakage.words(text)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_tiles_are_common_runs_and_disjoint():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
        got = leakage.tile(a, b, 3)
        used_a, used_b = set(), set()
        for p, t, k in got:
            assert k >= 3 and a[p : p + k] == b[t : t + k]
            assert not used_a & set(range(p, p + k)) and not used_b & set(range(t, t + k))
            used_a |= set(range(p, p + k))
            used_b |= set(range(t, t + k))
        longest = max((k for k in range(1, len(a) + 1) for p in range(len(a) - k + 1) if any(a[p : p + k] == b[t : t + k] for t in range(len(b)))), default=0)
        assert max((k for _, _, k in got), default=0) == (longest if longest >= 3 else 0)


def test_leaks_equal_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/eval_items.parquet").collect()]
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    e = spark.read.parquet(f"{tiny}/eval_items.parquet")
    for block in (leakage.BLOCK_WORDS, 500):
        got = leakage.tiles(d, e, block_words=block).filter("longest >= 13").collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items, 13)


def test_leaks_reordered_and_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    parts = item.split()
    turned = " ".join(parts[10:] + parts[:10])
    docs = [(1, turned.upper()), (2, item.replace(" ", "—")), (3, None), (4, ""), (5, "nothing here"), (2, item)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short one")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in leakage.leaks(leakage.tiles(d, e)).collect()}
    assert got == {(1, 1): "reordered", (2, 1): "whole"}
    assert leakage.tiles(d, e.filter("item_id > 9")).count() == 0
    assert leakage.tiles(d.filter("doc_id > 9"), e).count() == 0


# ---- shared spans


def test_fm_index_windows_against_brute_force():
    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        depth, sigma = rng.choice([3, 5, 8, 12]), rng.choice([2, 3, 5])
        texts = [np.array([rng.randrange(sigma) + 2 for _ in range(rng.randrange(0, 60))], int) for _ in range(rng.randrange(1, 8))]
        index = fmindex.FMIndex(texts, depth)
        for t, found in zip(texts, index.windows(texts), strict=True):
            assert len(found) == max(0, len(t) - depth + 1)
            for i, c in enumerate(found):
                key = t[i : i + depth].tolist()
                holders = {j for j, u in enumerate(texts) if any(u[k : k + depth].tolist() == key for k in range(len(u) - depth + 1))}
                assert set(index.owner[index.class_start[c] : index.class_end[c]].tolist()) == holders


def brute_pairs(docs, span):
    where: dict[str, set] = {}
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            where.setdefault(t[k : k + span], set()).add(d)
    pairs = {p for s in where.values() for p in itertools.combinations(sorted(s), 2)}
    cover = {}
    for d, t in docs:
        hit = set()
        for k in range(len(t or "") - span + 1):
            if len(where[t[k : k + span]]) > 1:
                hit |= set(range(k, k + span))
        cover[d] = len(hit)
    return pairs, cover


def made_texts(rng, n):
    base = ["".join(rng.choice("abcde \n") for _ in range(300)) for _ in range(4)] + ["a" * 400, "ab" * 200]
    docs = []
    for d in range(n):
        t = ""
        for _ in range(rng.randrange(0, 4)):
            if rng.random() < 0.6:
                s = rng.choice(base)
                i = rng.randrange(len(s) - 40)
                t += s[i : i + rng.randrange(40, 200)]
            t += "".join(rng.choice("abcdefé漢") for _ in range(rng.randrange(0, 50)))
        docs.append((d, rng.choice([t, t, t, None, ""]) if d % 7 == 0 else t))
    return docs


@pytest.mark.parametrize("hot", [10_000, 3, 0])
def test_shared_spans_equal_brute_force(spark, hot):
    docs = made_texts(random.Random(11), 80)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = shared_spans.find(df, span=60, gram=30, hot=hot, shard_chars=2_000)
    pairs, cover = brute_pairs(docs, 60)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in found.coverage().collect()} == cover
    classes: dict = {}
    for r in found.classes().collect():
        classes.setdefault((r.class_id, r.n_docs), set()).add(r.doc_id)
    assert all(len(v) == k[1] for k, v in classes.items())
    assert {p for v in classes.values() for p in itertools.combinations(sorted(v), 2)} == pairs


def test_shared_spans_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_spans.find(empty).pairs().count() == 0
    rng = random.Random(2)
    text = "".join(chr(97 + rng.randrange(26)) for _ in range(700))
    rows = [(1, text), (1, text), (2, text[100:500]), (3, text[:319]), (4, None)]
    found = shared_spans.find(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert {r.doc_id: r.shared_chars for r in found.coverage().collect()} == {1: 400, 2: 400, 3: 0, 4: 0}
