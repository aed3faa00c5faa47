"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpusloom.llm import (
    bpe_prefix,
    chat_rotation,
    components,
    decontamination,
    multiset_fingerprint,
    near_groups,
    recompression,
    simhash_dedup,
    site_style_tree,
    token_binary,
    toxicity_ordinal,
    url_markov,
)

WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(WORDS)
PASSAGE = " ".join(f"p{i}" for i in range(30))
ROWS = [
    (1, BASE, "a"), (2, BASE, "b"), (3, None, "c"), (4, "", "d"), (5, " \n\t", "e"), (6, "one two " + PASSAGE + " three", "f"), (7, "four " + PASSAGE + "\nfive six", "g"),
    (8, BASE.replace("w30", "x30"), "h"), (9, "é" * 3000 + " end", "i"), (9, "é" * 3000 + " end", "i"), (10, "same same " * 400, "j"), (11, "same same " * 400 + "z", "k"), (None, BASE, "l"),
    (12, "Short", "m"), (13, "short", "n"), (14, "a <|endoftext|> b　c 中文 ß", "o"),
]
SCHEMA = "doc_id bigint, text string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(rows, width):
    out = Counter()
    for doc, text, _ in rows:
        own, gone = words(text), set()
        for i in range(len(own) - width + 1):
            window = own[i : i + width]
            for other, said, _ in rows:
                if doc is not None and other is not None and other < doc:
                    theirs = words(said)
                    if any(theirs[j : j + width] == window for j in range(len(theirs) - width + 1)):
                        gone |= set(range(i, i + width))
                        break
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[doc, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width", [5, 13])
def test_repeats(docs, width):
    rows = [r for r in ROWS if r[0] not in (10, 11)] + [(10, "same same " * 20, "j"), (11, "same same " * 20 + "z", "k")]
    found = recompression.remove_repeats(docs.sparkSession.createDataFrame(rows, SCHEMA), width=width, keep_text=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == plain_repeats(rows, width)
    assert {r["row"] for r in found} == {r[2] for r in rows}  # the column named row passes through


def test_repeats_of_hash_breakers(spark):
    """Words and long runs of two words that a polynomial hash can't tell apart, periodic texts and binary texts."""
    rng = np.random.default_rng(11)
    morse = lambda n, a, b: [(a, b)[bin(i).count("1") & 1] for i in range(n)]
    common = [f"c{i}" for i in range(12)]
    texts = [
        " ".join([*common[:6], "".join(morse(1024, "a", "b")), *common[6:]]), " ".join([*common[:6], "".join(morse(1024, "b", "a")), *common[6:]]),
        " ".join(morse(2048, "x", "yy")), " ".join(morse(2048, "yy", "x")), " ".join(["p", "q", "r"] * 40), " ".join(["q", "r", "p"] * 30), "z " * 200, "z\t" * 90 + "end",
        *(" ".join(rng.choice(["0", "1"], 400)) for _ in range(6)),
    ]
    rows = [(i, t, str(i)) for i, t in enumerate(texts)]
    for width in (3, 13):
        found = recompression.remove_repeats(spark.createDataFrame(rows, SCHEMA), width=width).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == plain_repeats(rows, width)
    assert {r["doc_id"]: r["n_removed"] for r in found}[1] == 0


def test_repeats_of_nothing(empty):
    assert recompression.remove_repeats(empty).collect() == []


def test_simhash_components(docs, empty):
    out = simhash_dedup.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[None]["component_id"] == 1
    assert {by_id[i]["component_id"] for i in (3, 4, 5)} == {3} and by_id[4]["fp"] == 0
    assert by_id[12]["fp"] == by_id[13]["fp"] and by_id[9]["n_copies"] == 2
    fps = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in out}
    for a in fps:
        for b in fps:
            if a is not None and b is not None and bin(fps[a] ^ fps[b]).count("1") <= 4:
                assert by_id[a]["component_id"] == by_id[b]["component_id"]
    assert simhash_dedup.near_duplicates(empty).collect() == []


def test_close_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)}
    for p in list(points):
        for n in (1, 3, 4, 5):
            q = p
            for k in rng.choice(64, n, replace=False):
                q ^= 1 << int(k)
            points.add(q - (1 << 64) if q >= 1 << 63 else q if q >= -(1 << 63) else q + (1 << 64))
    points = [p for p in points if -(1 << 63) <= p < 1 << 63]
    want = {(min(a, b), max(a, b)) for a in points for b in points if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    got = [(r["a"], r["b"]) for r in simhash_dedup.close_pairs(spark.createDataFrame([(p,) for p in points], "fp bigint"), 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 102), (5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys(range(100, 104), 100)


def test_near_groups_keep_one(docs, empty):
    kept = near_groups.keep_one_of_each(docs, width=5, similarity=0.8).collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and ids[9] == 1 and ids[3] + ids[4] + ids[5] == 1
    # one changed word in sixty leaves 51 of 61 shingles: alike, by 0.836
    # and 6 and 7 share 26 shingles of 32
    assert ids[8] == 0 and ids[6] == 1 and ids[7] == 0 and ids[12] == ids[14] == 1
    assert near_groups.keep_one_of_each(empty).collect() == []


def brute_force_roots(texts, width=5, similarity=0.8):
    """The smallest id that chains of similar texts reach, for each id."""
    from corpusloom.llm.fingerprints import shingle_hashes

    sets = {i: set(shingle_hashes(t, width).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in texts}


def test_near_groups_of_hubs_and_chains(spark):
    rng = np.random.default_rng(3)

    def changed(own, at):
        return [f"c{int(rng.integers(1 << 40))}" if i in at else w for i, w in enumerate(own)]

    hub, texts = [f"h{i}" for i in range(200)], {}
    for i in range(120):  # each copy is like the hub, by 0.82 or more, and unlike the other copies
        if i != 60:
            texts[i] = " ".join(changed(hub, set(rng.choice(200, 4, replace=False).tolist())))
    texts[60] = " ".join(hub)
    link = [f"l{i}" for i in range(200)]
    for i in rng.permutation(40).tolist():  # each is like the next one alone
        texts[1000 + i] = " ".join(link)
        link = changed(link, {int(x) for x in rng.choice(200, 4, replace=False)})
    want = {i: r for i, r in brute_force_roots(texts).items() if r != i}
    assert len(want) > 150
    got = near_groups.dropped(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["id"]: r["root"] for r in got} == want


def test_all_texts_of_close_fingerprints_meet(spark):
    rows = [(1, 0b0, 9), (2, 0b0, 9), (3, 0b0, 9), (4, 0b11, 9), (5, 0b11, 9), (6, (1 << 62) - 1, 9)]
    met = {}
    for part in near_groups.fingerprint_buckets(spark.createDataFrame(rows, "id bigint, fp bigint, n bigint"), 4):
        for r in part.collect():
            met.setdefault((r["k"], r["print"]), set()).add(r["id"])
    assert sorted(map(sorted, met.values())) == [[1, 2, 3], [1, 2, 3, 4, 5], [4, 5]]


def test_near_groups_in_a_shared_passage(spark):
    # every text has the same 220 words and 40 of its own; similar pairs share 20 of those too
    passage, texts = " ".join(f"s{i}" for i in range(220)), {}
    for i in range(160):
        tail = [f"t{i}n{j}" for j in range(40)]
        if i >= 150:
            tail[:20] = texts[i - 150].split()[220:240]
        texts[i] = passage + " " + " ".join(tail)
    want = {i: r for i, r in brute_force_roots(texts).items() if r != i}
    assert set(want) == set(range(150, 160))
    got = near_groups.dropped(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["id"]: r["root"] for r in got} == want


def test_encoding(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for doc, text, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = bpe_prefix.encode_documents(docs, path, keep_ids=True).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe_prefix.encode_documents(empty, path).collect() == []


def test_token_files(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    at, want = 0, []
    for doc, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_binary.round_trip(docs, path, end_id=2).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert token_binary.round_trip(empty, path, end_id=2).collect() == []


def test_edited_fingerprints(docs, empty):
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for (doc, text, _), (_, following, _) in zip(order, order[1:] + order[:1], strict=True):
        changed = multiset_fingerprint.edited(text or "", following or "")
        want[doc, len(text or ""), hashlib.sha256(changed.encode()).hexdigest(), multiset_fingerprint.fingerprint(text).digest()] += 1
    got = multiset_fingerprint.edits(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert multiset_fingerprint.edits(empty).collect() == []
    alone = docs.where("doc_id = 12")
    assert multiset_fingerprint.edits(alone).first()["n_chars"] == 5


def test_contamination(docs, empty, spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.replace("p10", "q")), (3, None), (4, ""), (5, "one word more than is there")], "item_id bigint, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(6, 1), (6, 2), (7, 1), (7, 2)}
    assert {r["score"] for r in got if r["item_id"] == 1} == {1.0}
    assert {(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == 6 and r["item_id"] == 1} == {(2, 32)}
    left = decontamination.without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 2
    assert decontamination.contaminated(empty, items).collect() == decontamination.contaminated(docs, items.limit(0)).collect() == []
    assert decontamination.without_contaminated(docs, items.limit(0)).count() == len(ROWS)


def test_contamination_by_edited_and_partial_copies(spark):
    rng = np.random.default_rng(9)
    fresh = iter(range(1 << 30))

    def edited(text, at):
        own = text.split()
        for i in at:
            own[i] = f"x{next(fresh)}"
        return " ".join(own)

    items = {i: " ".join(f"i{i}w{int(x)}" for x in rng.integers(0, 9000, n)) for i, n in enumerate((38, 15, 59, 38))}
    copies = {10: edited(items[0], (4, 11, 18, 25, 32)), 11: edited(items[1], (4, 10)), 12: edited(items[2], range(5, 59, 7)), 13: " ".join(items[3].split()[:20])}
    texts = {d: " ".join(f"z{next(fresh)}" for _ in range(50)) + " " + t + " end" for d, t in copies.items()} | {20: " ".join(items[0].split()[:10])}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(rows, spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()}
    assert set(got) == {(10, 0), (11, 1), (12, 2), (13, 3)} and got[13, 3] == pytest.approx(20 / 38, abs=1e-6)


@pytest.mark.parametrize("hits", [1_000_000, 40])
def test_contamination_without_common_runs(spark, monkeypatch, hits):
    """Copies with every fourth, third or second word new or moved, among common words: all pairs by the whole table."""
    monkeypatch.setattr(decontamination, "HITS", hits)
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(15)]
    pick = lambda i, n: [str(rng.choice(common)) if rng.random() < 0.4 else f"i{i}w{int(rng.integers(0, 5000))}" for _ in range(n)]
    items = {i: pick(i, n) for i, n in enumerate((15, 38, 60, 24, 7, 3, 1))}
    fresh = iter(range(1 << 30))
    texts = {}
    for i, own in items.items():
        for step in (2, 3, 4, 5):
            texts[f"new {i} {step}"] = [w if (k + 1) % step else f"x{next(fresh)}" for k, w in enumerate(own)]
            texts[f"put in {i} {step}"] = [x for k, w in enumerate(own) for x in ([w] if (k + 1) % step else [w, f"x{next(fresh)}"])]
            texts[f"left out {i} {step}"] = [w for k, w in enumerate(own) if (k + 1) % step]
        texts[f"half {i}"] = own[len(own) // 2 :]
    texts = {k: [*rng.choice(common, 30), *t, *rng.choice(common, 30)] for k, t in texts.items()} | {f"noise {i}": list(rng.choice(common, 200)) for i in range(5)}
    want = {}
    for doc, b in texts.items():
        for item, a in items.items():
            number = {w: k + 1 for k, w in enumerate(dict.fromkeys(a))}
            score = decontamination.align(np.array([number[w] for w in a]), np.array([number.get(w, 0) for w in b], np.int64))[0] / (2 * len(a))
            if score >= 0.5:
                want[doc, item] = round(score, 6)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id string, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(docs, bench).collect()} == want
    assert {f"new {i} 4" for i in (0, 1, 2)} <= {d for d, _ in want}


def test_toxicity_on_texts_held_out(spark):
    rng = np.random.default_rng(4)
    bad = ["vile", "awful", "nasty", "rotten"]

    def text(toxic):
        own = [f"v{int(rng.zipf(1.5)) % 500}" for _ in range(int(rng.integers(5, 80)))]
        for _ in range(int(rng.integers(1, 8)) if toxic else 0):
            own.insert(int(rng.integers(0, len(own))), str(rng.choice(bad)))
        return " ".join(own)

    marks = [int(rng.random() < 0.2) for _ in range(900)]
    texts = [text(m) for m in marks]
    model = toxicity_ordinal.fit_texts(texts[:600], marks[:600])
    scored = [model.severity(t) for t in texts[600:]]
    hit = [int(s >= model.cut) for s, _ in scored]
    assert np.mean(np.array(hit) == np.array(marks[600:])) > 0.95
    assert model.severity("vile awful nasty rotten vile")[0] > model.severity("vile")[0] > model.severity("")[0] == model.severity(None)[0]
    docs = spark.createDataFrame([(1, "vile awful", 5), (2, None, 6), (3, "", 7)], "doc_id bigint, text string, grade int")
    rows = {r["doc_id"]: r for r in toxicity_ordinal.score(docs, model).collect()}
    assert rows[1]["toxic"] == 1 and rows[2]["toxic"] == rows[3]["toxic"] == 0 and list(rows[1].asDict()).count("grade") == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity_ordinal.fit(docs, labels)
    assert [r["toxic"] for r in toxicity_ordinal.score(docs, model).collect()] == [0, 0]


def test_url_rules_and_model(spark):
    rules = [url_markov.Rule("net", "/", "block"), url_markov.Rule("example.net", "/en/", "allow"), url_markov.Rule("org", "/fr/", "allow")]
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "https://example.net/de/"), (3, "x.net"), (4, None), (5, "http://x.net"), (6, "http://u.org/fr/2#a"), (7, "http://com/a?b=://x/y"), (7, "http://com/a?b=://x/y"), (8, "http://notexample.net/en/1")]
    rows += [(100 + i, f"http://good{i}.example.net/en/page{i}") for i in range(30)] + [(200 + i, f"http://spam{i}.net/win/cash{i}") for i in range(30)] + [(300, "http://good.com/en/page"), (301, "http://spam.com/win/cash")]
    got = {r["page_id"]: r for r in url_markov.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block") and got[8]["rule"] == "net/"
    assert (got[3]["host"], got[3]["path"], got[4]["host"], got[5]["rule"]) == ("", "", "", None)
    assert got[6]["rule"] == "org/fr/" and (got[7]["host"], got[7]["path"]) == ("com", "/a")
    assert got[300]["verdict"] == "allow" and got[301]["verdict"] == "block" and got[300]["score"] > got[301]["score"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_markov.judge(spark.createDataFrame([], "page_id bigint, url string"), rules).collect() == []


def plain_url_model(lines):
    """p(class, context, character) of lines (text, weight in either class), with Witten-Bell smoothing."""
    from collections import defaultdict

    counts = {0: defaultdict(lambda: defaultdict(float)), 1: defaultdict(lambda: defaultdict(float))}
    for line, *weights in lines:
        w = url_markov.START + line + url_markov.END
        for i in range(1, len(w)):
            for k in range(min(i, url_markov.ORDER) + 1):
                for cls in (0, 1):
                    if weights[cls]:
                        counts[cls][w[i - k : i]][w[i]] += weights[cls]

    def p(cls, ctx, c):
        value = 1 / url_markov.ALPHABET
        for k in range(len(ctx) + 1):
            seen = counts[cls].get(ctx[len(ctx) - k :])
            if seen:
                value = (seen.get(c, 0) + len(seen) * value) / (sum(seen.values()) + len(seen))
        return value

    return p


def test_url_model_against_plain_counts(spark):
    from math import log

    lines = [("abab", 2.0, 0.0), ("abc", 0.0, 1.0), ("ba", 1.0, 3.0)]
    p = plain_url_model(lines)
    train = url_markov.grams(spark.createDataFrame(lines, "line string, a double, b double"), "a", "b")
    asked = url_markov.grams(spark.createDataFrame([("abz",)], "line string")).distinct()
    got = {(r["ctx"], r["c"]): r["llr"] for r in url_markov.log_ratios(train, asked).collect()}
    assert len(got) == 4
    for (ctx, c), llr in got.items():
        assert llr == pytest.approx(log(p(0, ctx, c)) - log(p(1, ctx, c)), abs=1e-9)


def test_whole_url_filter_against_plain_models(spark):
    from math import floor, log

    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rules = [url_markov.Rule("net", "/", "block"), url_markov.Rule("org", "/fr/", "allow")]
    urls = [f"http://{rng.choice(['news', 'lore', 'book'])}{i % 9}.org/fr/{rng.choice(['page', 'item'])}{i % 13}" for i in range(60)]
    urls += [f"http://{rng.choice(['win', 'cash', 'spam'])}{i % 7}.net/x{i % 11}" for i in range(60)] + [f"http://{rng.choice(['news', 'cash', 'q'])}{i}.com/fr/{rng.choice(['item', 'x'])}" for i in range(30)] + [None, "", "http://", "http://" + "é/" * 2000]
    rows = [(i, u, "h", 1.0) for i, u in enumerate(urls)] + [(0, urls[0], "h", 1.0)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string, score double")
    got = url_markov.judge(frame, rules).collect()
    assert len(got) == len(rows)
    hosts = {r["host"] for r in got}
    held = {r["h"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").where(F.pmod(F.xxhash64("h"), F.lit(5)) == 0).collect()}
    ruled = [(r["host"], r["path"], r["verdict"]) for r in got if r["rule"]]
    weighted = lambda xs: [(h + p, float(v == "allow"), float(v == "block")) for h, p, v in xs]

    def score(p, line):
        w = url_markov.START + line + url_markov.END
        parts = [(w[max(0, i - url_markov.ORDER) : i], w[i]) for i in range(1, len(w))]
        return round(sum(log(p(0, x, c)) - log(p(1, x, c)) for x, c in parts) / len(parts), 6)

    part = plain_url_model(weighted([x for x in ruled if x[0] not in held]))
    marks = [(floor(min(max(score(part, h + p), -50), 50) * 100), v) for h, p, v in ruled if h in held]
    total = Counter(v for _, v in marks)
    cut = 0.0
    if len(total) == 2:
        gain = lambda at: sum(b >= at and v == "allow" for b, v in marks) / total["allow"] + sum(b < at and v == "block" for b, v in marks) / total["block"]
        cut = max(sorted({b for b, _ in marks}), key=lambda at: (gain(at), -at)) / 100
    whole = plain_url_model(weighted(ruled))
    for r in got:
        if r["rule"] is None:
            assert r["score"] == pytest.approx(score(whole, r["host"] + r["path"]), abs=2e-6)
            assert r["verdict"] == ("allow" if r["score"] >= cut else "block")
        else:
            assert r["score"] is None


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "é"), (2, 0, "system", "x"), (3, 0, None, "who"), (3, 1, "ann", "y"), (3, 1, "ann", "y"), (None, 0, "ann", "z")]
    got = chat_rotation.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "perspective", "position").collect()
    whole = {}
    for r in got:
        key = (r["conv_id"], r["perspective"])
        assert r["start"] == len(whole.get(key, "")) and r["end"] == r["start"] + len(r["rendered"])
        whole[key] = whole.get(key, "") + r["rendered"]
    assert set(whole) == {(1, "ann"), (1, "bob"), (3, "ann"), (None, "ann")}
    assert whole[1, "bob"] == "<|system|>\nS<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user name=ann|>\né<|end|>\n"
    assert whole[3, "ann"].startswith("<|user name=unknown|>\nwho")
    for r in got:
        if r["chat_role"] == "assistant":
            said = whole[r["conv_id"], r["perspective"]][r["loss_start"] : r["loss_end"]]
            assert said.endswith("<|end|>\n") and "<|assistant|>" not in said
        else:
            assert r["loss_start"] is None


def test_branches_that_repeat_go(spark):
    page = "<body><div class=x1><p>Same words on every page</p></div><div class=x2><p>Story {} of the day {}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i, "z" * i)) for i in range(12)] + [(50, None, None), (51, "http://h.org/", ""), (52, "http://other.org/", page.format("a", "b"))]
    got = {r["page_id"]: r for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3]["text"] == "Story 3 of the day zzz" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[50]["text"] == got[51]["text"] == "" and got[52]["text"].endswith("Story a of the day b")


def test_articles_of_repeated_pages_stay(spark):
    page = "<body><div class=x1><p>Same words on every page</p></div><article><p>Story {0} of the day {0}</p></article></body>"
    plain = "<body><div class=y2><p>Report {0}</p></div></body>"
    rows = [(i, "http://copies.org/a", page.format("one")) for i in range(30)]
    rows += [(100 + i, "http://hot.org/a", plain.format("one")) for i in range(180)] + [(300 + i, f"http://hot.org/{i}", plain.format(i)) for i in range(20)]
    rows += [(400 + i, f"http://m{i}.org/a", page.format("shared")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {got[i] for i in range(30)} == {"Story one of the day one"} and {got[400 + i] for i in range(12)} == {"Story shared of the day shared"}
    assert {got[100 + i] for i in range(180)} == {"Report one"} and [got[300 + i] for i in range(20)] == [f"Report {i}" for i in range(20)]
    blocks = site_style_tree.read(page.format(1)).blocks
    assert site_style_tree.main_text(blocks, {b[0] for b in blocks}) == "Story 1 of the day 1"


def test_entropies_decide_without_names(spark):
    """No article element, and a menu and an imprint of neutral names; the menu leaves out the page that is open."""
    rng = np.random.default_rng(2)
    menu = [f"Topic {i}" for i in range(9)]
    rows, want = [], {}
    for i in range(60):
        links = "".join(f"<li><a href='/{m}'>{m}</a>" for m in menu if m != menu[i % 9])
        own = [" ".join(f"w{x}" for x in rng.integers(0, 500, 12)) for _ in range(int(rng.integers(1, 9)))]
        body = "".join(f"<p>{t}</p>" for t in own)
        rows.append((i, f"http://plain.org/{i}", f"<body class=k1><div class=k2><ul>{links}</ul></div><div class=k3>{body}<p>Set in Garamond</p></div><div class=k4><p>Printed in Ghent</p><p>All rights</p></div></body>"))
        want[i] = "\n\n".join([*own, "Set in Garamond"])  # what the article itself repeats is not cut out of it
    rows += [(100, None, rows[0][2]), (101, "http://once.org/", rows[1][2]), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as low", "html as text", "'x' as host", "2 as node")
    got = site_style_tree.extract(frame).collect()
    assert len(got) == 63 and all(r["text"] == want[r["page_id"]] for r in got if r["page_id"] < 100)
    # the counts of all hosts stand in for a host with few pages
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] >= 100} == {100: want[0], 101: want[1]}
    assert site_style_tree.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_long_and_deep_pages(spark):
    deep = "<div class=abcdefgh>" * 20000 + "<p>in</p>"
    long = "<article>" + "<p>word</p>" * 50000
    rows = [(1, "http://a.org/", deep), (2, "http://a.org/", long), (3, "http://a.org/", "<a " * 40000), (4, "http://a.org/", "&nbsp;<p>\x00\ud7ff&#x110000;&bogus;</p>")]
    got = {r["page_id"]: r for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1]["text"] == "in" and got[2]["n_chars"] == 50000 * 6 - 2 and len(got) == 4


def test_queries_have_their_columns():
    from corpusloom.llm import queries

    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


def test_contamination_of_all_pairs_by_full_alignment(spark):
    """String ids, repeated items and rows, clashing columns: every pair, by the whole table of Smith-Waterman."""
    rng = np.random.default_rng(21)
    items = [(f"item-{i}", " ".join(f"w{x}" for x in rng.integers(0, 60, int(rng.integers(6, 25))))) for i in range(12)]
    items += [items[0], ("other", items[1][1]), (None, items[2][1]), ("short", "w1 w2"), ("none", "!!")]
    texts = []
    for i in range(40):
        own = [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(0, 60)))]
        copy = items[i % 12][1].split()
        for k in rng.integers(0, len(copy), int(rng.integers(0, 6))):
            copy[k] = "edited"
        texts.append((f"d{i}", " ".join(own[: len(own) // 2] + copy * (i % 3) + own[len(own) // 2 :]), "x", 0.5))
    texts += [texts[1], ("null", None, "x", 0.5), ("long", "w9 " * 30_000 + items[3][1], "x", 0.5)]
    docs = spark.createDataFrame(texts, "doc_id string, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontamination.contaminated(docs, bench).collect())

    word = lambda t: re.findall(r"\w+", (t or "").lower())
    want = Counter()
    for doc, text, *_ in texts:
        for item, said in items:
            a, b = word(said), word(text)
            if not a:
                continue
            number = {w: i + 1 for i, w in enumerate(dict.fromkeys(a))}
            best = decontamination.align(np.array([number[w] for w in a]), np.array([number.get(w, 0) for w in b], np.int64))[0] / (2 * len(a))
            if best >= 0.5:
                want[doc, item, round(best, 6)] += 1
    assert got == want and len({d for d, *_ in got}) > 15
    left = decontamination.without_contaminated(docs, bench)
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(t[0] for t in texts if not any(d == t[0] for d, *_ in want))


def test_perspectives_of_odd_conversations(spark):
    long = "é" * 200_000
    rows = [(1, 0, "ann", "", "a", 1), (1, 1, "bob", long, "b", 2), (1, 2, "ann", " \n", "c", 3)]
    got = chat_rotation.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, rendered string, position int")).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob")} and len(got) == 6
    assert max(len(r["rendered"]) for r in got) > 200_000
    assert chat_rotation.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_toxicity_of_ties_repeats_and_long_texts(spark):
    rng = np.random.default_rng(6)
    texts = {i: " ".join(f"v{x}" for x in rng.integers(0, 300, 60)) + (" vile rotten awful" if i % 4 == 0 else "") for i in range(240)}
    docs = [(i, t, 1, "kept") for i, t in texts.items()] + [(0, texts[0], 1, "kept"), (500, "vile rotten awful " * 20_000, 1, "kept"), (501, "qqqq " * 50_000, 1, "kept"), (None, texts[4], 1, "kept")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, toxic int, names string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in texts] + [(0, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    one, two = (toxicity_ordinal.fit(f, labels) for f in (frame, frame.orderBy("text")))
    assert one.weights == two.weights and one.cut == two.cut
    got = toxicity_ordinal.score(frame, one).collect()
    assert len(got) == len(docs) and Counter(r["names"] for r in got) == {"kept": len(docs)}
    by_id = {r["doc_id"]: r["toxic"] for r in got}
    assert by_id[500] == 1 and by_id[501] == 0 and by_id[None] == 1 and sum(by_id[i] == int(i % 4 == 0) for i in texts) > 232
    # the sample's bound holds, by rows and by bytes
    assert toxicity_ordinal.sample(frame, labels, 50, 1 << 30).count() <= 50
    held = toxicity_ordinal.sample(frame, labels, 1000, 5000).collect()
    assert 0 < sum(len(r["text"]) for r in held) <= 5000


def test_close_pairs_are_the_same_for_every_grid(spark):
    rng = np.random.default_rng(12)
    values = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    for v in values[:20]:
        for n in (1, 3, 4, 5):
            for k in rng.choice(63, n, replace=False).tolist():
                v ^= 1 << k
            values.append(v)
    values = sorted(set(values))
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    points = spark.createDataFrame([(v,) for v in values], "fp bigint")
    for agree in (3, 4, 5):
        found = [(r["a"], r["b"]) for r in simhash_dedup.close_pairs(points, 4, agree).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 20
    assert [simhash_dedup.agree_for(n, 4) for n in (10, 10**7, 10**8, 10**9, 10**12)] == [3, 3, 4, 6, 6]
