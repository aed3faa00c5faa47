"""The registered queries of this subpackage: thin digests of its operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import band_join, bpe_prefix, chat_rotation, decontamination, first_fit, multiset_fingerprint, recompression, simhash_dedup, site_style_tree, token_align, token_binary, toxicity_ordinal, url_markov
from corpusloom.llm.common import table

#: The rules of the URL query.
URL_RULES = [
    url_markov.Rule("net", "/", "block"),
    url_markov.Rule("example.net", "/en/", "allow"),
    url_markov.Rule("example.com", "/de/", "block"),
    url_markov.Rule("org", "/fr/", "allow"),
]
WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.round_trip(table(spark, sf_dir, "documents"), WORD_VOCAB, end_id=2)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.extract(table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash_dedup.hex16(F.col("fp")).alias("fingerprint"), "component_id", "n_copies")


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fingerprint.edits(table(spark, sf_dir, "documents"))


def op7_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode_documents(table(spark, sf_dir, "documents"), BYTE_VOCAB)


def op8_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"), width=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_ordinal.score(docs, model, columns=["doc_id"])


def op11_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_fit.pack(table(spark, sf_dir, "documents"), BYTE_VOCAB, end_id=0, capacity=1024)


def op12_numeric_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join.near_prices(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.aligned(table(spark, sf_dir, "documents"), BYTE_VOCAB, PIECE_VOCAB)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_perspectives": chat_rotation.SQL, "op12_numeric_band_join": band_join.SQL}
