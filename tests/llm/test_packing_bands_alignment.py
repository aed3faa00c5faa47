"""Packing, band join and alignment of tokenizers against plain code, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import band_join, first_fit, queries, token_align, token_ids

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "the cat sat"), (2, "the cat sat"), (2, "the cat sat"), (3, None), (4, ""), (5, " \n\t "), (6, "a <|endoftext|> b <s> </s>"), (7, "under▁score"), (8, "中文字 ß é 🎉 ̈a"), (None, "no id at all"),
    (9, "same same " * 3000), (10, "x" * 5000), (11, "é\u0000 end"), (12, "   many   spaces\n\n\nlines "), (13, "qzxj" * 700), (14, "é" * 3000),
]
CLASH = "doc_id bigint, text string, id string, block int, pair int, nth int, draw int, g int, task int, full int, rest int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", *[7] * 8) for i, t in TEXTS], CLASH)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def check_packing(rows, want, capacity):
    """rows against (id -> list of id lists): pieces gapless in documents and sequences, checksums, no padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at and length > 0
            at += length
            assert size == sum(x[1] for x in parts)
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    assert set(pieces) == {k for k, docs in want.items() if any(docs)}
    for k, docs in want.items():
        if len(docs) == 1 and docs[0]:
            at = 0
            for start, length, crc, total in sorted(pieces[k]):
                assert start == at and total == len(docs[0])
                at += length
                assert crc == zlib.crc32(np.array(docs[0][start : start + length], "<u4").tobytes())
            assert at == len(docs[0])
        else:
            assert sum(x[1] for x in pieces[k]) == sum(map(len, docs))


@pytest.mark.parametrize(("capacity", "end", "group"), [(1024, 0, 2000), (64, None, 3), (16, 5, 4)])
def test_packing(spark, docs, capacity, end, group):
    tokenizer, want = library(), defaultdict(list)
    for i, t in TEXTS:
        want[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]))
    rows = first_fit.pack(docs, BYTE, end_id=end, capacity=capacity, group=group, keep_ids=True).collect()
    check_packing(rows, want, capacity)
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    plain = first_fit.pack(docs, BYTE, end_id=end, capacity=capacity, group=group).collect()
    check_packing(plain, want, capacity)
    assert first_fit.pack(docs.where("false"), BYTE, end_id=end).collect() == []


def test_packing_query(spark):
    tokenizer = library()
    want = {r["doc_id"]: [tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(queries.op11_first_fit_packing(spark, SF).collect(), want, 1024)


def test_first_fit_is_the_plain_one():
    draw = random.Random(5)
    for n in (0, 1, 2, 3, 50, 257):
        sizes = [draw.choice([1, 2, 3, 10, 100, draw.randint(1, 128)]) for _ in range(n)]
        plain: list[list[int]] = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            for b in plain:
                if sum(sizes[k] for k in b) + sizes[i] <= 128:
                    b.append(i)
                    break
            else:
                plain.append([i])
        assert (first_fit.first_fit_decreasing(sizes, 128) if n else []) == plain
        full = first_fit.fill([[(i, 0, sizes[i]) for i in b] for b in plain], 128)
        got = Counter()
        for b in full:
            size = sum(x[2] for x in b)
            assert size == 128 or size & (size - 1) == 0
            for i, s, length in b:
                for at in range(s, s + length):
                    got[i, at] += 1
        assert got == Counter((i, at) for i in range(n) for at in range(sizes[i]))
        assert sum(map(len, full)) <= n + len(plain) + 8


def plain_bands(items, lines):
    cents = lambda x: None if x is None or x != x or abs(x) > 1e13 else int(np.floor(100 * x + 0.5))
    good = []
    for sale, no, item, q, amount in lines:
        if None not in (sale, item, q) and q and cents(amount) is not None:
            crc = zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())
            good.append(((2 * cents(amount) + q) // (2 * q), sale, no, item, crc))
    out = []
    for item, price in items:
        p = cents(price)
        pairs = [(abs(u - p), u, s, n, i, c) for u, s, n, i, c in good if p is not None and item is not None and i != item and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * min(u, p))]
        pairs.sort(key=lambda x: (*x[:3], -(1 << 63) if x[3] is None else x[3], x[4]))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs))
        out += [(item, k + 1, *x[:5], *sums) for k, x in enumerate(pairs[:10])] or [(item, 0, *[None] * 5, *sums)]
    return out


def test_band_join_on_hard_rows(spark, monkeypatch):
    draw = random.Random(3)
    prices = [0.01, 0.5, 0.51, 3.0, 3.0, 3.49, 50.0, 99.99, 100.0, 100.5, 101.0, 20000.0, -4.0, -4.3, 0.0, None, float("nan"), float("inf"), 1e200, 77.0]
    items = [(i, p) for i, p in enumerate(prices)] + [(3, 3.0), (3, 3.0), (None, 3.0), (3, 3.2), (99, 5e12)]
    lines = [(s, draw.choice([1, 2, None]), draw.choice([3, 3, 3, 4, 7, 8, 11, 99]), draw.choice([1, 1, 2, 3, 7, -2]), draw.choice([3.0, 3.0, 3.01, 6.0, 100.2, 201.0, 0.3, -8.0, 20050.0, 5e12, 4.999e12])) for s in range(1500)]
    lines += [lines[0]] * 40 + [(None, 1, 4, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 4, None, 3.0), (1, 1, 4, 1, None), (1, 1, 4, 0, 3.0), (1, 1, 4, 1, float("nan")), (1, 1, 4, 1, float("-inf"))]
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, price double, region int")
    ls = spark.createDataFrame([(*x, 1, 2) for x in lines], "sale_id bigint, line_no int, item_id bigint, quantity int, amount double, b int, nth int")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(plain_bands(items, lines), key=key)
    assert max(r[1] for r in want) == 10 and any(r[1] == 0 for r in want)
    for most in (500_000, 60):  # one rectangle, and prices cut into many
        monkeypatch.setattr(band_join, "LEAST", most if most < 1000 else 20_000)
        monkeypatch.setattr(band_join, "MOST", most)
        monkeypatch.setattr(band_join, "FAN", 2 if most < 1000 else 64)
        assert sorted((tuple(r) for r in band_join.near_prices(i, ls).collect()), key=key) == want
    none = sorted(((x, 0, *[None] * 5, 0, 0, 0) for x, _ in items), key=key)
    assert sorted((tuple(r) for r in band_join.near_prices(i, ls.where("false")).collect()), key=key) == none
    assert band_join.near_prices(i.where("false"), ls).collect() == []


def test_tiles_cover_the_band_once():
    draw = random.Random(9)
    for most in (20, 300, 5000):
        sides = []
        for n in (60, 900):
            found = Counter(draw.choice([draw.randint(-100, 400), 77, draw.randint(400, 90_000)]) for _ in range(n))
            by = defaultdict(list)
            for v in found:
                b = abs(v) if abs(v) <= 200 else 200 + int(np.floor(np.log(abs(v) / 200) * 200))
                by[b if v >= 0 else -b].append(v)
            sides.append(sorted((b, min(vs), max(vs), sum(found[v] for v in vs)) for b, vs in by.items()))
        strips, regions = band_join.tile(*sides, band_join.Band(), most)
        cells, used = Counter(), Counter()
        for strip in strips:
            for c0, c1, ci, cl, first in strip.rectangles:
                used.update(range(first, first + ci * cl))
                n_items = sum(x[3] for x in sides[0][strip.rows[0] : strip.rows[1] + 1])
                n_lines = sum(x[3] for x in sides[1][c0 : c1 + 1])
                assert n_items / ci + n_lines / cl <= 1.2 * most + 2
                cells.update((r, c) for r in range(strip.rows[0], strip.rows[1] + 1) for c in range(c0, c1 + 1))
        assert set(used) == set(range(regions)) and set(used.values()) <= {1} and set(cells.values()) <= {1}
        band = band_join.Band()
        for r, (_, p0, p1, _) in enumerate(sides[0]):
            for c, (_, u0, u1, _) in enumerate(sides[1]):
                if u1 >= band.low(p0) and u0 <= band.high(p1):
                    assert (r, c) in cells


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from corpusloom.llm.bpe_prefix import byte_names

    a_tok, names = Tokenizer.from_file(BYTE), byte_names()
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found, held = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a = [(x, bytes(names[c] for c in a_tok.id_to_token(x))) for x in a_tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode()) for x in sp.encode(text or "")]
        groups = []
        if text and b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b):
            ends = [set(np.cumsum([len(x[1]) for x in side]).tolist()) for side in (a, b)]
            both, at = ends[0] & ends[1], [0, 0]
            for end in sorted(both):
                part = []
                for k, side in enumerate((a, b)):
                    ids = []
                    while at[k] < end:
                        x, raw = side.pop(0)
                        ids.append(x)
                        at[k] += len(raw)
                    part.append(ids)
                groups.append(part)
        linked = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(linked.keys())
        found.append((i, groups, linked))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(
        i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()), sum(n for p, n in linked.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in linked.items()),
        hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "") for i, groups, linked in found], {i: groups for i, groups, _ in found}


def test_alignment(spark, docs):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want, groups = plain_alignment(TEXTS)
    got = token_align.aligned(docs.repartition(3), BYTE, PIECE).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r[3] for r in want) and sum(r[3] == 0 for r in want) >= 3
    assert token_align.aligned(docs.where("false"), BYTE, PIECE).collect() == []
    seen = defaultdict(list)
    for r in token_align.token_groups(docs.where("doc_id is null or doc_id <> 2"), BYTE, PIECE).orderBy("nth").collect():
        seen[r["doc_id"]].append([r["a"], r["b"]])
        assert r["end"] > r["start"]
    assert {k: v for k, v in groups.items() if v and k != 2} == dict(seen)


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op13_token_alignment(spark, SF).collect())) == sorted(plain_alignment(map(tuple, rows))[0])


def test_large_groups_of_links():
    g = token_align.Groups(np.array([True]), np.repeat(np.arange(3), 30), np.repeat(np.arange(5), 4), np.array([90]), np.array([20]), np.array([9]), np.array([0, 90]), np.array([0, 20]), np.array([0, 1]), np.array([0, 9]))
    text, pair, times = token_align.links(g)
    assert sorted(zip(pair.tolist(), times.tolist(), strict=True)) == [(x << 32 | y, 120) for x in range(3) for y in range(5)] and not text.any()
    x = np.array([0, 3, 254, 255, 256, 10**12])
    assert token_align.unsqueeze(*token_align.squeeze(x)).tolist() == x.tolist()


def test_ids_are_the_library_s_for_every_character():
    own, tokenizer, plain = token_ids.byte_ids(BYTE), library(), library()
    plain.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 2000):
        texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}. " for c in points[i : i + 2000][k : k + 50]) for k in range(0, 2000, 50)]
        for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.ids(text).tolist() == want.ids
    for text in ("a <|endoftext|> b<|endoftext|>", "x" * 100_000, " " * 1_000_000 + "y", "<|endoftext|>" + "\n" * 700_000):
        assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert own.plain(text).tolist() == plain.encode(text, add_special_tokens=False).ids
