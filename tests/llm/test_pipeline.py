"""The stages on planted cases."""

import numpy as np

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(7)

    def prose(n):
        return " ".join(f"k{int(x)}" for x in rng.integers(0, 4000, n))

    texts = {i: prose(120) for i in range(200)}
    bad = list(range(0, 200, 5))
    for i in bad:
        texts[i] += " " + " ".join(rng.choice(["vile", "nasty", "rotten", "awful"], 4))
    item, passage = prose(30), prose(60)
    texts |= {300: prose(100), 301: prose(40) + " " + passage + " " + prose(40), 302: passage + " " + prose(70), 303: prose(50) + " " + item + " " + prose(20), 304: None, 305: prose(80) + " vile nasty awful rotten"}
    texts[310] = texts[300]
    parts = texts[300].split()
    parts[50] = "edited"
    texts[311] = " ".join(parts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"]: r for r in now.collect()})
    toxic, near, repeats, clean, encoded = seen
    assert 305 not in toxic and not set(bad) & set(toxic) and len(set(range(200)) - set(toxic) - set(bad)) <= 2
    assert 300 in near and 310 not in near and 311 not in near and {301, 302, 303} <= set(near)
    assert passage in repeats[301]["text"] and passage not in repeats[302]["text"] and repeats[302]["n_chars"] == len(repeats[302]["text"])
    assert repeats[301]["text"] == texts[301]
    assert 303 not in clean and {300, 301, 302} <= set(clean) and set(clean) == set(encoded)
    assert all(len(r["ids"]) == r["n_tokens"] for r in encoded.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(encoded)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs2 = stage(spark, docs, str(tmp_path))
        assert docs2.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, ties and extra columns whose names the stages use themselves."""
    long, text = " ".join(f"k{i}" for i in range(40_000)), " ".join(f"t{i}" for i in range(50))
    rows = [(1, None, 0), (1, text, 0), (1, text, 0), (2, "", 0), (None, text, 0), (None, None, 0), (3, long, 0), (4, "t" * 50_000, 0), (5, " \n ", 0), (6, "one two", 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, "id", 1.0) for i, t, k in rows], DOCS + ", toxic int, id string, kept double")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is here at all"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in now.select("doc_id").collect())
        assert (True, 3) in ids and (True, 6) in ids and ids.count((False, 0)) == 2
