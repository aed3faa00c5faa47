"""Edges of earlier operators: clashing columns, very long values, repeated ids, and likeness against exact counts."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import multiset_fingerprint, near_groups, queries, token_binary, url_markov

CLASH = "doc_id bigint, text string, id string, at bigint, piece int, extra boolean, head int, bucket int, place double"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, 3, True, 1, 2, 0.5) for i, t in rows], CLASH)


def test_likeness_is_that_of_word_runs(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 400) % 500) for _ in range(8)]
    texts += [texts[0], "\n".join(texts[1].split(" ")[k : k + 40] and " ".join(texts[1].split(" ")[k : k + 40]) for k in range(0, 400, 40))]
    got = {r["doc_id"]: r for r in multiset_fingerprint.edits(clashing(spark, enumerate(texts))).collect()}

    def runs(text):
        out = Counter()
        for line in text.split("\n"):
            words = line.split()
            out.update(tuple(words[k : k + multiset_fingerprint.RUN]) for k in range(len(words)))
        return out

    def cosine(a, b):
        a, b = runs(a), runs(b)
        return sum(n * b[k] for k, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        following = texts[i - 1] if i else texts[-1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        # 512 signed lanes tell a cosine to about 1 / sqrt(512)
        assert got[i]["near_edited"] == pytest.approx(cosine(text, changed), abs=0.2)
        assert got[i]["near_next"] == pytest.approx(max(0.0, cosine(text, following)), abs=0.2)
    assert np.mean([abs(got[i]["near_next"] - max(0.0, cosine(t, texts[i - 1] if i else texts[-1]))) for i, t in enumerate(texts)]) < 0.08
    assert got[0]["fingerprint"] == got[8]["fingerprint"]


def test_token_files_of_rows_with_clashing_columns(spark):
    from tokenizers import Tokenizer

    rows = [(3, "Some words here"), (1, None), (2, "é ß 中文"), (None, "no id"), (2, "again two")]
    got = token_binary.round_trip(clashing(spark, rows), queries.WORD_VOCAB, end_id=2).collect()
    library = Tokenizer.from_file(queries.WORD_VOCAB)
    want = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_very_long_urls(spark):
    long = "x" * 300_000
    rows = [(1, f"http://a.example.net/en/{long}?q=1"), (2, f"http://{long}.com/de/"), (3, "http://example.com/de/x"), (4, f"http://shop.org/{long}#y"), (5, None), (6, ""), (7, f"{long}"), (7, f"{long}")]
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in rows], "page_id int, url string, host string, path string, rule string")
    got = {r["page_id"]: r for r in url_markov.judge(pages, queries.URL_RULES).collect()}
    assert got[1]["rule"] == "example.net/en/" and got[1]["verdict"] == "allow" and len(got[1]["path"]) == 300_004
    assert len(got[2]["host"]) == 300_004 and got[2]["rule"] is None and got[2]["verdict"] in ("allow", "block")
    assert got[3]["verdict"] == "block" and got[4]["host"] == "shop.org" and got[5]["host"] == got[6]["path"] == got[7]["host"] == ""


def test_repeated_ids_with_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 1), (1, text, "b", 2), (1, "quite another text of its own", "c", 3), (2, text, "d", 4), (3, "alone", "e", 5), (None, text, "f", 6), (None, text, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, count bigint")
    got = near_groups.keep_one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    # of rows that repeat an id the one with the smallest text stays, with its own other columns
    assert kept == sorted([rows[2], rows[4], rows[5], rows[6]], key=str)
