"""Queries over communities, the agent's loop, exact similarity joins and percentiles of hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import agent, assembly, communities, dispatch, impact, paging, presentation, segments, similar, understanding
from corpusloom.operators import index as I
from corpusloom.operators import maintenance as M
from corpusloom.operators import retrieval as R
from corpusloom.plans.retrieval_queries import BM25, FUSED, TFIDF, Q, asked
from corpusloom.registry import REGISTRY
from corpusloom.session import load, shared_dir
from corpusloom.sources import readers
from corpusloom.streaming import state

add = REGISTRY.add


def trade(spark, sf):
    """Vendors (negative) and items, linked by how many lines they share."""
    lines = load(spark, sf, "sale_lines").where("item_id is not null and vendor_id is not null")
    return lines.groupBy((-1 - F.col("vendor_id")).alias("src"), F.col("item_id").alias("dst")).agg(F.count("*").alias("weight"))


@add("g10_louvain")
def g10_louvain(spark, sf):
    return communities.louvain(trade(spark, sf))


@add("g10_modularity", """with e as (select -1 - c_nationkey as src, c_custkey as dst, 1 + c_custkey % 3 as w from customer union all select -1 - s_nationkey, -1000 - s_suppkey, 2 from supplier union all select c_custkey, o_orderkey + 1000000000, 1 from orders join customer on c_custkey = o_custkey),
  p as (select -1 - n_nationkey as id, n_regionkey as community from nation union all select c_custkey, n_regionkey from customer join nation on c_nationkey = n_nationkey union all select -1000 - s_suppkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey
    union all select o_orderkey + 1000000000, o_orderkey % 5 from orders), b as (select src, dst, w from e union all select dst, src, w from e), n as (select a.community as x, c.community as y, w from b join p a on a.id = src join p c on c.id = dst),
  t as (select x, sum(w) as total, coalesce(sum(w) filter (x = y), 0) as inside from n group by x) select round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total))::double, 9) as modularity from t""")
def g10_modularity(spark, sf):
    customer, nation, supplier, orders = (load(spark, sf, t) for t in ("customer", "nation", "supplier", "orders"))
    big = lambda c: F.col(c).cast("bigint")
    order = (big("o_orderkey") + 1_000_000_000).alias
    edges = customer.select((-1 - big("c_nationkey")).alias("src"), F.col("c_custkey").alias("dst"), (1 + F.col("c_custkey") % 3).cast("double").alias("weight"))
    edges = edges.unionByName(supplier.select((-1 - big("s_nationkey")).alias("src"), (-1000 - big("s_suppkey")).alias("dst"), F.lit(2.0).alias("weight")))
    edges = edges.unionByName(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(big("c_custkey").alias("src"), order("dst"), F.lit(1.0).alias("weight")))
    region = nation.select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("community"))
    parts = region.select((-1 - big("n_nationkey")).alias("id"), "community").unionByName(customer.join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(big("c_custkey").alias("id"), "community"))
    parts = parts.unionByName(supplier.join(region, F.col("s_nationkey") == F.col("n_nationkey")).select((-1000 - big("s_suppkey")).alias("id"), "community")).unionByName(orders.select(order("id"), (big("o_orderkey") % 5).alias("community")))
    return communities.modularity(edges, parts).select(F.round("modularity", 9).alias("modularity"))


def agent_tools(spark, sf, k=5):
    index = I.indexed(load(spark, sf, "documents"))
    return {name: lambda queries, name=name: R.TOOLS[name](index, queries, k) for name in ("vector_search", "keyword_search", "hybrid_search")}


#: Words of the benchmark that tell its questions apart, as the fixed ones are of another language.
KINDS = [("factual", ["ar"], "vector_search"), ("policy", ["el"], "keyword_search"), ("procedural", ["or"], "hybrid_search")]


@add("r28_agent_loop")
def r28_loop(spark, sf):
    """The whole items of the benchmark as queries."""
    queries = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    history, _ = agent.run(queries, agent_tools(spark, sf), load(spark, sf, "documents"), types=KINDS)
    return history


@add("i03_similar_entries", """with e as (select vec_id, embedding::double[] as v from embeddings), q as (select * from e where vec_id % 20 = 0)
  select q.vec_id as query_id, e.vec_id as entry_id, round(list_cosine_similarity(q.v, e.v), 6) as similarity from q, e where round(list_cosine_similarity(q.v, e.v), 6) >= 0.3""")
def i03b(spark, sf):
    """Queries are the vectors whose id is divisible by 20, against all."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similar.cosine_join(e.where("id % 20 = 0"), e, 0.3).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("entry_id"), "similarity")


@add("q13_corpus_variants")
def q13c(spark, sf):
    """The words of the benchmark against the vocabulary of all documents."""
    words = lambda table: load(spark, sf, table).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return similar.similar_words(words("benchmark"), words("documents"), 0.85)


@add("a08_client_percentiles", """with r as (select client_id, value, row_number() over (partition by client_id order by value) as rn, count(*) over (partition by client_id) as n from clicks where value is not null)
  select client_id, any_value(n) as n, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high, round(max(value) filter (rn = least(floor(n * 0.5::double), n - 1) + 1), 6) as p50, round(max(value) filter (rn = least(floor(n * 0.95::double), n - 1) + 1), 6) as p95, round(max(value) filter (rn = least(floor(n * 0.99::double), n - 1) + 1), 6) as p99 from r group by client_id""")
def a08b(spark, sf):
    return M.percentile_stats(load(spark, sf, "clicks"), ["client_id"], "value")


LIVE = """live as (select doc_id, case when quality = 0 then text || ' et erth of' else text end as text from documents left join (select doc_id as l, any_value(quality) as quality, max(toxic) as toxic from labels group by doc_id) on l = doc_id where coalesce(toxic, 0) = 0)"""


@add("st5_segments", f"with {BM25.replace('from documents', 'from live').replace('as (values', 'as (values', 1)}".replace("with queries", f"with {LIVE}, queries", 1) + " select query_id, doc_id, round(score, 6) as score from bm")
def st5(spark, sf):
    """All documents, then a change of those labelled bad and a deletion of those labelled toxic; searched after that."""
    index = segments.SegmentedIndex(spark, f"{shared_dir(spark)}/corpusloom/segments-{uuid.uuid4().hex}")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    labels = load(spark, sf, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("quality"), F.max("toxic").alias("toxic"))
    index.apply(docs)
    index.apply(docs.join(labels.where("quality = 0 or toxic = 1"), "doc_id").select("doc_id", F.when(F.col("quality") == 0, F.concat("text", F.lit(" et erth of"))).otherwise(F.col("text")).alias("text"), (F.col("toxic") == 1).alias("deleted")))
    return index.bm25(asked(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@add("st3_last_values", """with r as (select client_id as key, ts, value from clicks where ts is not null and value is not null), n as (select key, max(ts) as newest from r group by key), a as (select * from n where newest > (select max(newest) from n) - interval 7 day),
  l as (select r.*, row_number() over (partition by r.key order by ts desc, value desc) as back from r join a on r.key is not distinct from a.key where ts > newest - interval 7 day) select key, count(*) as n, round(sum(value), 6) as total from l where back <= 10 group by key""")
def st3(spark, sf):
    return state.last_values_of(load(spark, sf, "clicks"), "client_id", 10, 7 * 86_400)


def school(spark, sf):
    """A graph of vendors as courses, items as concepts and nations as requirements: (nodes, edges, communities)."""
    vendors, items, nation = load(spark, sf, "vendors"), load(spark, sf, "items"), load(spark, sf, "nation")
    big = lambda c: F.col(c).cast("bigint")
    nodes = vendors.groupBy("vendor_id").agg(F.min("name").alias("name")).where("vendor_id is not null").select(big("vendor_id").alias("id"), F.lit("course").alias("type"), "name", F.concat(F.lit("V"), F.col("vendor_id").cast("string")).alias("code"), (F.col("vendor_id") % 8 + 1).cast("int").alias("semester"))
    nodes = nodes.unionByName(items.groupBy("item_id").agg(F.min("name").alias("name")).select((big("item_id") + 10_000_000).alias("id"), F.lit("concept").alias("type"), "name", F.lit("").alias("code"), F.lit(None).cast("int").alias("semester")))
    nodes = nodes.unionByName(nation.select((big("n_nationkey") + 20_000_000).alias("id"), F.lit("requirement").alias("type"), F.col("n_name").alias("name"), F.lit("").alias("code"), F.lit(None).cast("int").alias("semester")))
    lines = load(spark, sf, "sale_lines").where("vendor_id is not null and item_id is not null and quantity > 40").select(big("vendor_id").alias("src"), (big("item_id") + 10_000_000).alias("dst"), F.lit("teaches").alias("type")).distinct()
    supports = vendors.where("nation_id is not null and vendor_id is not null").select(big("vendor_id").alias("src"), (big("nation_id") + 20_000_000).alias("dst"), F.lit("supports").alias("type")).distinct()
    ids = vendors.where("vendor_id is not null").select(big("vendor_id").alias("src")).distinct()
    chain = ids.where("src % 4 < 3").select("src", (F.col("src") + 1).alias("dst"))
    edges = lines.unionByName(supports).unionByName(chain.withColumn("type", F.lit("prerequisite"))).unionByName(chain.withColumn("type", F.lit("leads_to")))
    return nodes, edges, nodes.select("id", (F.col("id") % 7).alias("community"))


@add("g13_dispatched")
def g13_all(spark, sf):
    """Questions about the names of all nations, each with a vendor's, one for each strategy."""
    nodes, edges, groups = school(spark, sf)
    vendor = nodes.where("type = 'course'").select(F.col("id").alias("v"), F.col("name").alias("vendor"))
    names = load(spark, sf, "nation").join(vendor, F.col("v") == F.col("n_nationkey"), "left").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"), F.coalesce("vendor", "n_name").alias("vendor"))
    ways = F.array(F.lit("先修 "), F.lit("覆盖度 "), F.lit("概述 "), F.lit("what of "))
    queries = names.select(F.posexplode(ways).alias("w", "way"), "n", "name", "vendor").select((F.col("n") * 4 + F.col("w")).alias("query_id"), F.concat("way", "name").alias("query"), F.array("name", "vendor").alias("keywords"))
    return dispatch.dispatched(queries, nodes, edges, groups)


@add("k09_page_chunks")
def k09_pages(spark, sf):
    """Whole documents as lines on pages of 45; short lines with a capital are headings."""
    docs = load(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    paged = readers.synthetic_pages(lines, "doc_id", "pos")
    level = F.when(F.col("line").rlike(r"^[A-ZÄÖÜÉÈ][^.!?;]{0,39}$"), 1 + F.length("line") % 3)
    return paging.chunk_pages(paged, docs.select("doc_id", F.col("source").alias("title")), script="latin", heading=level, hints=[])


@add("x12_split_durations", """with t as (select conv_id as run_id, max(turn) + 1.5 as seconds from conversations group by conv_id), s as (select conv_id as run_id, turn as ord, role as name from conversations), n as (select run_id, count(*) as n from s group by run_id)
  select s.run_id, ord, name, round(seconds * 1000 / n, 6) as milliseconds from s join t using (run_id) join n using (run_id) where n >= 4 union all select run_id, 1, '默认推理', round(seconds * 1000, 6) from t join n using (run_id) where n < 4""")
def x12_durations(spark, sf):
    turns = load(spark, sf, "conversations")
    steps = turns.select(F.col("conv_id").alias("run_id"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("name"))
    totals = turns.groupBy(F.col("conv_id").alias("run_id")).agg((F.max("turn") + 1.5).alias("seconds"))
    return presentation.split_durations(steps, totals).withColumn("milliseconds", F.round("milliseconds", 6))


@add("t11_display_blocks")
def t11_blocks(spark, sf):
    """Whole documents as display blocks, for the first words of each, and as a source's excerpt."""
    # what all four look at is found once for each text
    docs = load(spark, sf, "documents").select("doc_id", "text", T.key_sentences(F.col("text"), 8).alias("keys"), T.first_keywords(F.col("text"), 3).alias("words"))
    text, words, keys = F.col("text"), F.col("words"), F.col("keys")
    return docs.select("doc_id", presentation.display(text, script="latin", hints=[], keys=keys).alias("shown"), presentation.query_display(text, words, script="latin", hints=[], keys=keys).alias("for_query"), presentation.source_excerpt(text, script="latin", hints=[], keys=keys).alias("excerpt"), presentation.answer_markdown(F.slice(keys, 1, 3), "latin", []).alias("bullets"))


@add("a15_decision_trees")
def a15_trees(spark, sf):
    return presentation.decision_trees(r28_loop(spark, sf))


@add("r23_cross_pipeline")
def r23_cross(spark, sf):
    """The whole items of the benchmark, searched by their keywords."""
    index = I.indexed(load(spark, sf, "documents"))
    queries = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = load(spark, sf, "documents").select("doc_id", F.col("source").alias("section"))
    docs, summary = presentation.cross_pipeline(queries, lambda asked_: index.best_bm25(asked_, 5), texts)
    listed = docs.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id", "keyword"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["keyword"].alias("keyword"))).alias("documents"))
    return summary.join(listed, "query_id", "left").withColumn("documents", F.to_json("documents"))


@add("x13_answers")
def x13(spark, sf):
    """The whole items of the benchmark as questions of the first pipeline."""
    index = I.indexed(load(spark, sf, "documents"))
    queries = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = load(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("section"))
    return presentation.answers(queries, lambda asked_: index.best_tfidf(asked_, 30), texts, "agent")


#: Whole items of the benchmark as queries, hundreds at once.
ITEMS = "queries as (select item_id as query_id, text as query from benchmark)"


def items(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@add("r02_items_bm25", f"with {BM25.replace(Q, ITEMS)} select query_id, rank, doc_id, round(score, 6) as score from bmr where rank <= 10")
def r02_items(spark, sf):
    return I.indexed(load(spark, sf, "documents")).best_bm25(items(spark, sf), 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@add("r01_items_tfidf", f"with {(BM25 + TFIDF).replace(Q, ITEMS)} select query_id, rank, doc_id, round(score, 6) as score from tir where rank <= 10")
def r01_items(spark, sf):
    return I.indexed(load(spark, sf, "documents")).best_tfidf(items(spark, sf), 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@add("r10_items_rrf", f"with {FUSED.replace(Q, ITEMS)}, r as (select *, row_number() over (partition by query_id order by round(fused, 9) desc, doc_id) as rank from f2) select query_id, rank, doc_id, round(fused, 6) as fused, channels from r where rank <= 10")
def r10_items(spark, sf):
    index = I.indexed(load(spark, sf, "documents"))
    both = R.channel(index.best_bm25(items(spark, sf), 30), "keyword").unionByName(R.channel(index.best_tfidf(items(spark, sf), 30), "vector", 1))
    return R.top_k(R.fuse(both, {"vector": 0.6, "keyword": 0.4}), 10, "fused").select("query_id", "rank", "doc_id", F.round("fused", 6).alias("fused"), "channels")


@add("q11_perspectives", """with r(perspective, kw) as (values ('ends', ['ing', 'tion']), ('articles', ['the', 'der', 'les']), ('none', ['qqqq'])), h as (select item_id as query_id, perspective, len(list_filter(kw, lambda k: contains(text, k))) as hits from benchmark cross join r), m as (select query_id, max(hits) as most from h group by query_id)
  select query_id, perspective, hits from h join m using (query_id) where hits > 0 or most = 0""")
def q11(spark, sf):
    rules = spark.createDataFrame([("ends", ["ing", "tion"]), ("articles", ["the", "der", "les"]), ("none", ["qqqq"])], "perspective string, keywords array<string>")
    return understanding.perspectives(items(spark, sf), rules)


@add("r02_impact_blocks", f"with {BM25.replace(Q, ITEMS)} select query_id, rank, doc_id, round(score, 6) as score from bmr where rank <= 10")
def r02_impact(spark, sf):
    """As r02_items_bm25, by blocks of impact."""
    return impact.bm25_top(I.indexed(load(spark, sf, "documents")), items(spark, sf), 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@add("q08_entities", "select item_id, array_to_string(list_filter(['erth', 'onhe', 'tion', 'zzzz'], lambda w: contains(text, w)), ',') as entities from benchmark")
def q08_entities(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", F.array_join(assembly.entities(F.col("text"), ["erth", "onhe", "tion", "zzzz"]), ",").alias("entities"))


@add("t07_t08_fragments", r"""with s as (select doc_id, pos, trim(regexp_replace(s, '\s+', ' ', 'g'), ' ') as line from (select doc_id, unnest(l) as s, unnest(range(len(l))) as pos from (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]?'), lambda x: trim(x, ' ')), lambda x: length(x) >= 1) as l from documents))),
  x as (select doc_id, pos, line, length(line) >= 28 and contains(line, 'the') and contains(line, 'of') as rows, list_filter(list_transform(string_split(regexp_replace(line, '(the|of)(\s*[：:]|\s+)', chr(1) || '\1\2', 'g'), chr(1)), lambda y: regexp_replace(y, '^[ ，、；：,.]+|[ ，、；：,.]+$', '', 'g')), lambda y: y <> '') as x from s),
  j as (select *, array_to_string(list_transform(x, lambda y: case when length(replace(y, ' ', '')) < 8 then ' ' || y else chr(1) || y end), '') as j from x),
  f as (select *, list_filter(string_split(regexp_replace(j, '^[^' || chr(1) || ']*', ''), chr(1)), lambda y: y <> '') as f from j), p as (select doc_id, pos, unnest(case when not rows or len(f) = 0 then [line] else f end) as p from f)
  select doc_id, count(*) as n, sum(length(p)) as chars from p where length(p) >= 12 group by doc_id""")
def t07_t08(spark, sf):
    f = load(spark, sf, "documents").select("doc_id", F.explode(T.fragments(F.col("text"), ["the", "of"])).alias("p"))
    return f.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))
