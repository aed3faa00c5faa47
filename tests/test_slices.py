"""Work on slices of a batch, and what is found once for several columns, against the plain way."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import presentation, sections


def test_children_of_many_parents(spark, monkeypatch):
    monkeypatch.setattr(sections, "PARENTS", 3)
    texts = [None, "", "short", *("Some words stand here. " * n for n in range(1, 40))]
    df = spark.createDataFrame(list(enumerate(texts)), "parent_id bigint, text string").coalesce(1)
    got = sorted((r["parent_id"], r["ord"], r["text"]) for r in sections.children(df).collect())
    assert got == sorted((p, i, c) for p, t in enumerate(texts) for i, c in enumerate(sections.split_children(t or "", 250, 50, 80)))


def test_display_of_known_sentences(spark):
    rows = [("First sentence about Gamma rays. Second sentence is as long. Third one follows here. Gamma ends the text now.",), ("no ends\nonly lines here\n",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string").withColumn("keys", T.key_sentences(F.col("text"), 8))
    c, words = F.col("text"), F.array(F.lit("Gamma"))
    for plain, known in [(f(c, *more, script="latin", hints=[]), f(c, *more, script="latin", hints=[], keys=F.col("keys"))) for f, more in ((presentation.display, ()), (presentation.query_display, (words,)), (presentation.source_excerpt, ()))]:
        assert df.where(~plain.eqNullSafe(known)).isEmpty()
