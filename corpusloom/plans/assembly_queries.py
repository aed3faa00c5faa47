"""Queries over folds, harvesting, assembly and what remains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assembly as A
from corpusloom.operators import evaluation as E
from corpusloom.operators import graph as G
from corpusloom.operators import index as I
from corpusloom.operators import maintenance as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import understanding as U
from corpusloom.plans.retrieval_queries import ASKED, BM25, Q, add, asked, bm
from corpusloom.session import load

#: Ordered distinct values of a list in SQL.
FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
#: Sentences of a text in SQL, as functions.text.sentences cuts them.
SENT = "list_filter(list_transform(regexp_extract_all({0}, '[^。！？；.!?;\\n]+[。！？；.!?;]?'), lambda s: trim(s, ' ')), lambda s: length(s) >= 12)"
COLLAPSED = "list_transform({0}, lambda s: trim(regexp_replace(replace(s, '　', ' '), '\\s+', ' ', 'g'), ' '))"
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


@add("c10_soft_wraps", f"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) as l from documents), k as (select doc_id, {FIRSTS.format('l')} as k from l)
  select doc_id, md5(case when len(k) = 0 then '' else list_reduce(k, lambda a, x: case when length(string_split(a, chr(10))[-1]) < 120 and not contains('。！？；.!?;:：', right(string_split(a, chr(10))[-1], 1)) then a || x else a || chr(10) || x end) end) as digest from k""")
def c10(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(F.array_join(A.merge_soft_wraps(F.split("text", "\n")), "\n")).alias("digest"))


@add("c21_slices", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
  a as (select doc_id, min(pos) filter (contains(lower(line), 'the')) as a from l group by doc_id), b as (select doc_id, min(pos) as b from l join a using (doc_id) where pos > a and length(line) < 30 group by doc_id)
  select doc_id, count(*) as n_lines, sum(pos) as positions from l join a using (doc_id) left join b using (doc_id) where a is null or (pos >= a and (b is null or pos < b)) group by doc_id""")
def c21(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return A.slice_between(lines, F.contains(F.lower("line"), F.lit("the")), F.length("line") < 30).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("pos").alias("positions"))


@add("t08_labelled_rows", "select doc_id from documents where length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 28 and contains(text, 'the') and contains(text, 'of')")
def t08(spark, sf):
    return load(spark, sf, "documents").where(T.labelled(F.col("text"), ["the", "of"])).select("doc_id")


@add("t05_keyword_overlap", r"with t as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2)) as k from benchmark) select a.item_id as a, b.item_id as b, len(list_intersect(a.k, b.k)) as shared, round(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))::double, 6) as jaccard from t a join t b on b.item_id = a.item_id + 1")
def t05(spark, sf):
    k = load(spark, sf, "benchmark").select("item_id", F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= 2)).alias("k"))
    j = k.select(F.col("item_id").alias("a"), F.col("k").alias("x"), (F.col("item_id") + 1).alias("b")).join(k.select(F.col("item_id").alias("b"), F.col("k").alias("y")), "b")
    n = F.size(F.array_intersect("x", "y"))
    return j.select("a", "b", n.alias("shared"), F.round(n / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@add("t21_topics", r"select distinct topic from (select unnest(regexp_extract_all(text, '(\p{L}{4,8})tion', 1)) as topic from documents) where length(topic) between 2 and 20 order by topic limit 20")
def t21(spark, sf):
    return A.topics(load(spark, sf, "documents"), patterns=[r"(\p{L}{4,8})tion"])


@add("t23_key_content", r"""with t as (select doc_id, text, substr(text, 151, 50) as tail from documents), a as (select *, length(regexp_extract(tail, '(?s)^(.*[。！？.!?])', 1)) as ends, length(regexp_extract(tail, '(?s)^(.*) ', 1)) as space from t)
  select doc_id, case when length(text) <= 200 then text when ends > 0 then substr(text, 1, 150 + ends) when space > 0 then substr(text, 1, 150 + space) || '...' else substr(text, 1, 200) || '...' end as content from a""")
def t23(spark, sf):
    return load(spark, sf, "documents").select("doc_id", A.key_content(F.col("text")).alias("content"))


@add("k11_document_summaries", f"""with h as (select source as doc_id, doc_id as ord, string_split(text, chr(10))[1] as title, list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2) as toks, row_number() over (partition by source order by doc_id) as n from documents),
  k as (select doc_id, n, title, ({FIRSTS.format('toks')})[1:3] as k from h where n <= 10), g as (select doc_id, list(title order by n) as titles, flatten(list(k order by n)) as words from k group by doc_id), f as (select doc_id, list_filter(titles, lambda t: t <> '') as titles, words from g)
  select doc_id, array_to_string(({FIRSTS.format('titles')})[1:5], '；') as titles, array_to_string(({FIRSTS.format('words')})[1:8], ' ') as keywords from f""")
def k11(spark, sf):
    d = load(spark, sf, "documents")
    return A.document_summary(d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text"))


@add("k15_levels", "select p_partkey, case when contains(p_type, 'STEEL') then 'program_spec' else 'course_outline' end as kind, array_to_string(list_transform(string_split(p_brand || '>' || p_type, '>'), lambda x: trim(x)), ' > ') as path from part")
def k15(spark, sf):
    kind = F.when(F.col("p_type").contains("STEEL"), "program_spec").otherwise(A.document_kind(F.col("p_name")))
    return load(spark, sf, "part").select("p_partkey", kind.alias("kind"), A.section_path(F.concat_ws(">", "p_brand", "p_type")).alias("path"))


@add("r31_merge_adjacent", f"""with {BM25}, r as (select query_id, rank, lang as section, text from bmr join documents using (doc_id) where rank <= 20),
  n as (select *, case when lag(section) over (partition by query_id order by rank) = section then 0 else 1 end as new from r), i as (select *, sum(new) over (partition by query_id order by rank rows unbounded preceding) as island from n),
  b as (select *, floor((sum(length(text)) over (partition by query_id, island order by rank rows unbounded preceding) - 1) / 520) as block from i)
  select query_id, min(rank) as rank, any_value(section) as section, md5(string_agg(text, chr(10) order by rank)) as digest, count(*) as parts from b group by query_id, island, block""")
def r31(spark, sf):
    hits = R.top_k(bm(spark, sf), 20).join(load(spark, sf, "documents").select("doc_id", F.col("lang").alias("section"), "text"), "doc_id")
    return A.merge_adjacent(hits.select("query_id", "rank", "section", "text")).select("query_id", "rank", "section", F.md5("text").alias("digest"), "parts")


@add("r33_evidence", f"""with {BM25}, t as (select query_id, rank, ({FIRSTS.format('c')})[1:2] as s from (select query_id, rank, {COLLAPSED.format(SENT.format('text'))} as c from bmr join documents using (doc_id) where rank <= 5)),
  u as (select query_id, rank, unnest(s) as sentence, unnest(range(len(s))) as pos from t), o as (select *, row_number() over (partition by query_id, sentence order by rank, pos) as rn from u),
  p as (select *, row_number() over (partition by query_id order by rank, pos) as place from o where rn = 1) select query_id, place, sentence from p where place <= 6""")
def r33(spark, sf):
    return A.evidence(R.top_k(bm(spark, sf), 5).join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("query_id", "rank", "text"))


@add("r23_first_of_each", f"with {BM25} select query_id, rank, doc_id from (select *, row_number() over (partition by doc_id order by query_id, rank) as rn from bmr where rank <= 10) where rn = 1")
def r23(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("query_id", "rank")
    return R.top_k(bm(spark, sf), 10).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("query_id", "rank", "doc_id")


@add("r28_best_iteration", "select user_id as query_id, event_id as iteration, max(value) over (partition by user_id order by event_id rows unbounded preceding) as best from events")
def r28(spark, sf):
    steps = load(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("iteration"), F.col("value").alias("confidence"))
    return E.best_so_far(steps).select("query_id", "iteration", "best")


@add("e06_overall", """with m as (select user_id, avg(value) / 1000 as p, case when count(*) > 1 then max(value) / 2000 end as r, min(value) / 3000 as m, case when count(*) filter (event_type = 'error') > 0 then avg(value) filter (event_type = 'error') / 4000 end as d from events group by user_id)
  select user_id, round((0.35::double * p + 0.30::double * coalesce(r, 0) + 0.20::double * m + 0.15::double * coalesce(d, 0)) / (0.35::double + case when r is null then 0 else 0.30::double end + 0.20::double + case when d is null then 0 else 0.15::double end), 6) as overall from m""")
def e06(spark, sf):
    v = F.col("value")
    m = load(spark, sf, "events").groupBy("user_id").agg((F.avg(v) / 1000).alias("p"), F.when(F.count("*") > 1, F.max(v) / 2000).alias("r"), (F.min(v) / 3000).alias("m"), (F.avg(F.when(F.col("event_type") == "error", v)) / 4000).alias("d"))
    return m.select("user_id", F.round(E.overall(F.col("p"), F.col("r"), F.col("m"), F.col("d")), 6).alias("overall"))


@add("e11_approval", "select event_id, event_id % 4 < 2 or value < 30 as refused, case when event_id % 4 < 2 or value < 30 then 'high' when event_id % 5 >= 3 then 'medium' else 'low' end as risk from events")
def e11(spark, sf):
    a = E.approval(F.col("event_id") % 4, F.col("value") / 100, F.col("event_id") % 5)
    return load(spark, sf, "events").select("event_id", (~a["approved"]).alias("refused"), a["risk"].alias("risk"))


@add("a11_counters", "select event_type, event_id, sum(1) over (partition by event_type order by event_id rows unbounded preceding) as counter from events")
def a11(spark, sf):
    e = load(spark, sf, "events")
    return M.running_counters(e.select("event_type", "event_id", F.lit(1).alias("delta")), "event_type", "event_id").select("event_type", "event_id", "counter")


@add("a13_type_counts", "select p_type as type, count(*) as n from part group by p_type")
def a13(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"))


@add("g12_filtered_graph", "with e as (select distinct l_partkey as src, l_suppkey as dst from lineitem), n as (select p_partkey as id from part where p_size < 10) select src, dst from e where src in (select id from n) and dst in (select id from n)")
def g12(spark, sf):
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    n = load(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return G.subgraph(n, e, n.withColumnRenamed("id", "node"))[1]


@add("x05_missing_names", "select n_name as name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 8000)")
def x05(spark, sf):
    n = load(spark, sf, "nation")
    has = load(spark, sf, "supplier").where("s_acctbal > 8000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return A.readiness(n.select(F.col("n_name").alias("name")), has.distinct())


@add("x09_original_similarity", "select vec_id, coalesce(case when vec_id % 2 = 0 then 0.5 end, embedding[1]::double) as original from embeddings")
def x09(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", A.first_similarity(F.when(F.col("vec_id") % 2 == 0, 0.5), F.element_at("embedding", 1).cast("double")).alias("original"))


@add("x12_traces", "select conv_id as run_id, string_agg(role, '>' order by turn) as steps, round(sum(length(text)) / 100.0::double, 6) as seconds, round(avg(length(text) / 100.0::double), 6) as each from conversations group by conv_id")
def x12(spark, sf):
    return A.trace(load(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), F.col("role").alias("name"), (F.length("text") / 100.0).alias("seconds"))).withColumn("seconds", F.round("seconds", 6))


@add("x20_log_records", """select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as line from events""")
def x20(spark, sf):
    return load(spark, sf, "events").select("event_id", A.log_record("event_id", "event_type").alias("line"))


@add("x21_half_range", "select event_type, round(avg(value), 6) as mean, round((max(value) - min(value)) / 2, 6) as spread from events group by event_type")
def x21(spark, sf):
    return A.half_range(load(spark, sf, "events"), "event_type", "value")


@add("l05_listing", "select conv_id, max(turn) as last_turn from conversations group by conv_id order by last_turn desc, conv_id limit 10 offset 5")
def l05(spark, sf):
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").offset(5).limit(10)


@add("l08_except", "select doc_id from documents except select doc_id from labels")
def l08(spark, sf):
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@add("x19_message_list", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations where length(text) > 0) select conv_id, string_agg(case role when 'assistant' then 'assistant' else 'user' end, ',' order by turn) as roles from r where back <= 6 group by conv_id")
def x19(spark, sf):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    r = load(spark, sf, "conversations").where("length(text) > 0").withColumn("back", back).where("back <= 6")
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: F.when(x["role"] == "assistant", "assistant").otherwise("user")), ",").alias("roles"))


KEYWORD_Q = "q0(query_id, query) as (values " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + f"), q1 as (select query_id, list_filter({TOKENS.format('query')}, lambda t: length(t) >= 2) as toks from q0), queries as (select query_id || '|' || kw as query_id, kw as query from (select query_id, unnest(({FIRSTS.format('toks')})[1:8]) as kw from q1))"


@add("r21_keyword_searches", f"with {BM25.replace(Q, KEYWORD_Q)} select query_id as search, rank, doc_id, round(score, 6) as score from bmr where rank <= 5")
def r21(spark, sf):
    """One search for each keyword of each query."""
    words = asked(spark).select("query_id", F.explode(T.first_keywords(F.col("query"))).alias("query"))
    numbered = words.select(F.concat_ws("|", "query_id", "query").alias("query_id"), "query")
    found = R.top_k(I.indexed(load(spark, sf, "documents")).bm25(numbered), 5)
    return found.select(F.col("query_id").alias("search"), "rank", "doc_id", F.round("score", 6).alias("score"))


@add("c02_corpus_lines", r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents), c as (select doc_id, pos, trim(regexp_replace(trim(regexp_replace(replace(replace(line, '•', ' '), '　', ' '), '\s+', ' ', 'g'), ' '), '^[| ]+|[| ]+$', '', 'g'), ' ') as line from l) select doc_id, md5(string_agg(line, chr(10) order by pos)) as digest from c group by doc_id")
def c02(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", T.corpus_line(F.col("line")))
    return lines.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("digest"))


@add("t04_query_keywords", f"with t as (select item_id, list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2) as toks from benchmark) select item_id, array_to_string(({FIRSTS.format('toks')})[1:6], ' ') as keywords from t")
def t04(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", F.array_join(T.first_keywords(F.col("text"), 6), " ").alias("keywords"))


@add("t12_t17_mentions", r"with p as (select p_partkey, '见第' || (p_size + 1) || '章，' || p_brand || ' p. ' || p_partkey || '；CSE' || lpad((p_partkey % 1000)::varchar, 3, '0') || '《' || p_type || '》' as x from part) select p_partkey, regexp_extract(x, '(第[一二三四五六七八九十百零\d]+[章节条款]|[一二三四五六七八九十]+、[^。\n]{1,20})', 1) as title, regexp_extract(x, '(?i)(第?\s*\d+\s*页|p\.\s*\d+)', 1) as page, array_to_string(list_concat(regexp_extract_all(x, '[A-Z]{2,4}[0-9]{3}'), regexp_extract_all(x, '《([^》]+)》', 1)), '|') as mentions from p")
def t12(spark, sf):
    code = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    x = F.concat(F.lit("见第"), (F.col("p_size") + 1).cast("string"), F.lit("章，"), "p_brand", F.lit(" p. "), F.col("p_partkey").cast("string"), F.lit("；CSE"), code, F.lit("《"), "p_type", F.lit("》"))
    return load(spark, sf, "part").select("p_partkey", T.section_title(x).alias("title"), T.page_reference(x).alias("page"), F.array_join(T.course_mentions(x), "|").alias("mentions"))


@add("k03_kept_sections", "select doc_id from documents where length(text) >= 120 and not (contains(text, '课程体系与毕业要求') or contains(text, '矩阵')) and (contains(source, '7') or contains(left(text, 240), '7') or contains(left(text, 240), 'the') or contains(left(text, 240), 'eau'))")
def k03(spark, sf):
    return load(spark, sf, "documents").where(A.keep_section(F.col("source"), F.col("text"), ["7", "the", "eau"])).select("doc_id")


@add("q15_dynamic_weight", "select item_id, round(greatest(0.3::double, least(0.8::double, 0.6::double - case when length(text) < 120 then 0.1::double else 0 end - case when regexp_matches(text, '[0-9]') then 0.1::double else 0 end + case when contains(text, 'th') then 0.05::double else 0 end)), 6) as weight from benchmark")
def q15(spark, sf):
    w = U.dynamic_weight(F.length("text") < 120, F.col("text").rlike("[0-9]"), F.col("text").contains("th"))
    return load(spark, sf, "benchmark").select("item_id", F.round(w, 6).alias("weight"))


@add("e01_relevant", """select case_id, doc_id from documents cross join (values (1, ['src1'], []::varchar[], ['the'], []::bigint[]), (2, [], ['fr', 'de'], [], []), (3, [], [], [], [5, 6]), (4, [], [], [], []), (5, ['src2', 'src3'], ['en'], ['ing', 'tion'], [])) c(case_id, docs, types, must, ids)
  where list_contains(ids, doc_id) or ((len(docs) > 0 or len(types) > 0 or len(must) > 0) and (len(docs) = 0 or len(list_filter(docs, lambda d: contains(source, d))) > 0) and (len(types) = 0 or list_contains(types, lang)) and (len(must) = 0 or len(list_filter(must, lambda m: not contains(lower(text), m))) = 0))""")
def e01(spark, sf):
    rows = [(1, ["src1"], [], ["the"], []), (2, [], ["fr", "de"], [], []), (3, [], [], [], [5, 6]), (4, [], [], [], []), (5, ["src2", "src3"], ["en"], ["ing", "tion"], [])]
    cases_ = spark.createDataFrame(rows, "case_id int, docs array<string>, types array<string>, must array<string>, ids array<bigint>")
    d = load(spark, sf, "documents").crossJoin(F.broadcast(cases_))
    none = F.array().cast("array<string>")
    chunk = {"id": F.col("doc_id"), "document": F.col("source"), "section": F.lit(""), "type": F.col("lang"), "text": F.col("text")}
    case = {"ids": F.col("ids"), "documents": F.col("docs"), "sections": none, "types": F.col("types"), "must": F.col("must"), "acceptable": none}
    return d.where(E.is_relevant(chunk, case)).select("case_id", "doc_id")


COURSES = "co as (select 'C' || p_partkey as id, p_name as name, case when p_partkey % 3 = 0 then ['C' || (p_partkey - 1)] else [] end as pre, case when p_partkey % 5 = 0 then ['C' || (p_partkey + 2)] else [] end as nxt, string_split(lower(p_type), ' ') as concepts, ['R' || p_size % 7] as objectives from part)"


def courses(spark, sf):
    n, none = F.col("p_partkey"), F.array().cast("array<string>")
    code = lambda c: F.concat(F.lit("C"), c.cast("string"))
    return load(spark, sf, "part").select(
        code(n).alias("id"), F.col("p_name").alias("name"), F.when(n % 3 == 0, F.array(code(n - 1))).otherwise(none).alias("prerequisites"), F.when(n % 5 == 0, F.array(code(n + 2))).otherwise(none).alias("leads_to"),
        F.split(F.lower("p_type"), " ").alias("concepts"), F.array(F.concat(F.lit("R"), (F.col("p_size") % 7).cast("string"))).alias("objectives"),
    )


@add("g01_edges", f"with {COURSES} select distinct src, dst, type from (select unnest(pre) as src, id as dst, 'prerequisite' as type from co union all select id, unnest(nxt), 'leads_to' from co union all select id, unnest(concepts), 'contains' from co union all select id, unnest(objectives), 'supports' from co)")
def g01(spark, sf):
    return A.course_graph(courses(spark, sf))[1]


@add("g01_nodes", f"with {COURSES} select id, 'course' as type, name from co union all select distinct c, 'concept', c from (select unnest(concepts) as c from co) union all select distinct o, 'requirement', o from (select unnest(objectives) as o from co)")
def g01b(spark, sf):
    return A.course_graph(courses(spark, sf))[0]


@add("g02_concept_levels", "with k as (select p_partkey as ord, case when p_size % 3 = 0 then '' else p_container end as level, unnest(string_split(lower(p_type), ' ')) as concept from (select *, p_mfgr_ as p_container from (select *, 'L' || p_size % 5 as p_mfgr_ from part)) where p_partkey % 2 = 0) select concept, arg_min(level, ord) filter (level <> '') as level from k group by concept")
def g02(spark, sf):
    p = load(spark, sf, "part")
    chunks = p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("course"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("L"), (F.col("p_size") % 5).cast("string"))).alias("level"), F.split(F.lower("p_type"), " ").alias("concepts"))
    return A.concept_levels(chunks, p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("course")))


@add("g13_routes", "with q as (select p_partkey as query_id, p_name || ['学习路径', '覆盖度', '整体', '专业介绍', ''][p_partkey % 5 + 1] as query, p_size % 4 as hits from part), s as (select *, case p_partkey_ when 0 then 'path' when 1 then 'alignment' when 2 then 'community' when 3 then 'community' else 'subgraph' end as strategy from (select *, query_id % 5 as p_partkey_ from q)) select query_id, strategy, round(case strategy when 'path' then 0.85 when 'alignment' then 0.8 when 'community' then least(0.95, 0.7 + 0.1 * hits) else 0.75 end::double, 6) as score, left(md5(strategy || '|' || query), 8) as id from s")
def g13(spark, sf):
    p = load(spark, sf, "part")
    word = F.element_at(F.array(*map(F.lit, ["学习路径", "覆盖度", "整体", "专业介绍", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return G.routed(p.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", word).alias("query"), (F.col("p_size") % 4).alias("hits")))


@add("v03_ego", """with e as (select distinct p_partkey - 1 as src, p_partkey as dst from part where p_partkey % 3 = 0 union select p_partkey, p_partkey + 2 from part where p_partkey % 5 = 0), n as (select p_partkey as id, p_name as name, p_brand as category from part),
  b as (select dst as center, 'prerequisite' as kind, src as node from e union select src, 'next', dst from e), s as (select *, row_number() over (partition by category order by name, id) as at from n),
  r as (select x.id as center, 'related' as kind, y.id as node from s x join s y on x.category = y.category and y.at between x.at - 4 and x.at + 4 and x.id <> y.id where not exists (select 1 from b where b.center = x.id and b.node = y.id)),
  p as (select u.center, u.kind, u.node, row_number() over (partition by center, kind order by name, node) as place from (select * from b union all select * from r) u join n on n.id = u.node) select center, kind, place, node from p where place <= 4""")
def v03(spark, sf):
    p = load(spark, sf, "part")
    edges = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") - 1).alias("src"), F.col("p_partkey").alias("dst")).union(p.where("p_partkey % 5 = 0").select("p_partkey", F.col("p_partkey") + 2))
    return G.ego(edges, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category")))


@add("s12_live_sessions", "with s as (select user_id as session_id, max(ts) as updated_at from events group by user_id) select session_id, updated_at from s where updated_at + interval 86400 second > timestamp '2024-01-30 00:00:00'")
def s12(spark, sf):
    s = load(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated_at"))
    return M.live_sessions(s, F.lit("2024-01-30 00:00:00").cast("timestamp"))


@add("r33_x18_responses", f"""with {BM25}, t as (select query_id, rank as place, string_split(text, chr(10))[1] as sentence from bmr join documents using (doc_id) where rank <= 3 and query_id <> 2), l as (select query_id, string_agg('- ' || sentence, chr(10) order by place) as lines from t group by query_id),
  k as (select query_id, query, ['greeting', 'curriculum', 'help', 'credit', 'general'][query_id + 1] as kind, lines from queries left join l using (query_id))
  select query_id, kind, case when kind = 'help' then '{A.HELP.format("x")}' when lines is null then '{A.FALLBACK[0]}' || query || '{A.FALLBACK[1]}' when kind = 'curriculum' then '{A.TEMPLATES["curriculum"][0]}' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '{A.TEMPLATES["curriculum"][1]}'
    when kind = 'credit' then '{A.TEMPLATES["credit"][0]}' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '{A.TEMPLATES["credit"][1]}' else '{A.TEMPLATES["general"][0]}' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '{A.TEMPLATES["general"][1]}' end as response from k""")
def r33b(spark, sf):
    hits = R.top_k(bm(spark, sf), 3).where("query_id <> 2").join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    points = hits.select("query_id", F.col("rank").alias("place"), F.element_at(F.split("text", "\n"), 1).alias("sentence"))
    kind = F.element_at(F.array(*map(F.lit, ["greeting", "curriculum", "help", "credit", "general"])), F.col("query_id") + 1)
    return A.themed_responses(asked(spark), points, "x", kind)


NOTES = {"a": ["影响评估", "one", "two"], "b": ["条件分析", "three"]}


@add("x11_narratives", """with s as (select p_size as query_id, case p_size % 3 when 0 then 'a' when 1 then 'b' else 'c' end as pattern, row_number() over (partition by p_size order by p_partkey) as place, p_brand as section, string_split(lower(p_type), ' ') as keywords, p_name as reason, [p_name, p_type, p_brand] as excerpts from part),
  f as (select query_id, pattern, place, case when query_id % 7 = 0 then null else section end as section, keywords, reason, excerpts from s),
  l as (select query_id, any_value(pattern) as pattern, string_agg('   - 《' || section || '》：涉及 ' || array_to_string(keywords, ', ') || ' 等关键词（' || reason || '）', chr(10) order by place) filter (place <= 3 and section is not null) as lines, string_agg('   - ' || excerpts[1] || chr(10) || '   - ' || excerpts[2], chr(10) order by place) filter (place <= 2 and section is not null) as points from f group by query_id)
  select query_id, concat_ws(chr(10), '相关规章关联分析：', case when lines is null then chr(10) || '1. 未发现直接关联的章节' || chr(10) || chr(10) || '2. 将基于各关键词独立分析相关规定' else concat_ws(chr(10), chr(10) || '1. 章节关联：', lines, chr(10) || '2. 规章要点：', points) end,
    case pattern when 'a' then chr(10) || chr(10) || '3. 影响评估：' || chr(10) || '   - one' || chr(10) || '   - two' when 'b' then chr(10) || chr(10) || '3. 条件分析：' || chr(10) || '   - three' end,
    case when lines is null then chr(10) || chr(10) || '4. 结论：' || chr(10) || '   - 各项规定相对独立，需分别了解' else chr(10) || chr(10) || '4. 结论：' || chr(10) || '   - 多项规章存在明确关联，需综合考虑' || chr(10) || '   - 建议同时参考所有相关规定' end) as narrative from l""")
def x11(spark, sf):
    p = load(spark, sf, "part")
    place = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    s = p.select(F.col("p_size").alias("query_id"), F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "b").otherwise("c").alias("pattern"), place.alias("place"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("section"), F.split(F.lower("p_type"), " ").alias("keywords"), F.col("p_name").alias("reason"), F.array("p_name", "p_type", "p_brand").alias("excerpts"))
    return A.correlations(s, NOTES)


@add("x14_enriched_context", "with b as (select conv_id, turn, text from conversations) select a.conv_id as query_id, md5(concat_ws(chr(10) || chr(10), a.text, string_agg(b.text, chr(10) || chr(10) order by b.turn))) as context from b a left join b on b.conv_id = a.conv_id and b.turn > 0 where a.turn = 0 group by a.conv_id, a.text")
def x14(spark, sf):
    c = load(spark, sf, "conversations")
    found = A.enriched_context(c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("context")), c.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.col("text").alias("block")))
    return found.withColumn("context", F.md5("context"))
