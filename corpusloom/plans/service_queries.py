"""Queries over query understanding, chunks, graphs, maintenance, sessions and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assembly as A
from corpusloom.operators import graph as G
from corpusloom.operators import maintenance as M
from corpusloom.operators import sections as S
from corpusloom.operators import understanding as U
from corpusloom.plans.retrieval_queries import add
from corpusloom.session import load
from corpusloom.sources import readers

#: Questions put together from the terms of the rules, one for each part.
TERMS = [t for terms in U.INTENTS.values() for t in terms] + ["Python3", "你好", "比较", "绩点", "GPU 加速"]
LINKS = ["", "和", "的区别", " and ", "还有", " 以及 "]
QUESTIONS = f"q0 as (select p_partkey as query_id, {TERMS!r}[p_partkey % {len(TERMS)} + 1] || {LINKS!r}[p_partkey % {len(LINKS)} + 1] || case when p_partkey % 4 = 0 then '' else {TERMS!r}[(p_partkey * 7) % {len(TERMS)} + 1] end || case when p_partkey % 3 = 0 then '？' else '' end as query from part)"


def cases(spark, sf):
    key = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    query = F.concat(pick(TERMS, key), pick(LINKS, key), F.when(key % 4 == 0, "").otherwise(pick(TERMS, key * 7)), F.when(key % 3 == 0, "？").otherwise(""))
    return load(spark, sf, "part").select(key.alias("query_id"), query.alias("query"))


def any_of(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def analysis_sql() -> str:
    hits = lambda terms: " + ".join(f"case when contains(q, '{t}') then 1.0::double when contains(lower(q), '{t.lower()}') then 0.8::double else 0 end" for t in terms)
    scored = ", ".join(f"{{'n': -round(least(({hits(terms)}) / {len(terms)}, 1), 3), 'o': {i}, 'name': '{name}'}}" for i, (name, terms) in enumerate(U.INTENTS.items()))
    synonyms = ", ".join(f"case when len(list_filter(keywords, lambda k: contains('{n}', k) or k in ({', '.join(repr(o) for o in others)}))) > 0 then {[n, *others[:2]]!r} else [] end" for n, others in U.SYNONYMS.items())
    technical = U.TECHNICAL
    return rf"""{QUESTIONS}, q1 as (select query_id, query, trim(regexp_replace(replace(translate(query, '（）：；！？，．【】“”‘’"' || chr(39), '():;!?,.[]'), '　', ' '), '\s+', ' ', 'g'), ' ') as q from q0),
  q2 as (select *, list_filter(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2) as toks, list_sort(list_filter([{scored}], lambda x: x.n < 0)) as found from q1),
  q3 as (select *, (list_filter(toks, lambda x, i: list_position(toks, x) = i))[1:8] as keywords, case when len(found) > 0 then list_transform(found, lambda x: x.name) else ['general'] end as intents from q2),
  q4 as (select *, regexp_matches(q, '{technical}') as tech from q3),
  q5 as (select *, case when tech then 'technical' when {any_of('q', U.POLICY)} or list_has_any(intents, ['scholarship', 'student_affairs']) then 'policy' when {any_of('q', U.PROGRAM)} or list_has_any(intents, ['training', 'curriculum', 'practice', 'credit']) then 'program' else 'general' end as category,
    least(5, 1 + (len(intents) >= 2)::int + (len(keywords) >= 4)::int + (length(q) >= 30)::int + {any_of('q', U.COMPARE)}::int) as complexity, length(q) as n from q4),
  q6 as (select *, case when (complexity <= 1 and n <= 12) or regexp_matches(q, '{U.SIMPLE}') then 'simple' when complexity >= 4 or len(intents) >= 2 or {any_of('q', U.MULTI_HOP)} then 'complex' when {any_of('q', U.COMPARE_LONG)} and n >= 15 then 'complex' else 'standard' end as route,
    case complexity when 1 then 4 when 2 then 5 when 3 then 6 when 4 then 8 else 10 end as k, case when n <= 8 then 0.45::double when n >= 20 then 0.25::double else 0.3::double end as k1, case when n <= 8 then 0.55::double when n >= 20 then 0.75::double else 0.7::double end as v1,
    list_filter(keywords, lambda w: regexp_matches(w, '{technical}')) as terms, flatten([{synonyms}]) as syn from q5),
  q7 as (select *, case category when 'policy' then greatest(k1, 0.58::double) when 'program' then least(k1, 0.45::double) when 'technical' then greatest(k1, 0.62::double) else k1 end as k2, case category when 'policy' then least(v1, 0.42::double) when 'program' then greatest(v1, 0.55::double) when 'technical' then least(v1, 0.38::double) else v1 end as v2,
    list_filter([q, case when category = 'technical' then array_to_string(terms, ' ') else array_to_string((list_filter(syn, lambda x, i: list_position(syn, x) = i))[1:4], ' ') end], lambda v: trim(v, ' ') <> '') as vs from q6),
  q8 as (select *, case when tech then least(k2 + 0.1::double, 0.6::double) else k2 end as k3, (list_filter(vs, lambda x, i: list_position(vs, x) = i))[1:3] as variants from q7), q9 as (select *, case when tech then greatest(1 - k3, 0.4::double) else v2 end as v3 from q8)"""


@add("q01_q07_analysis", f"with {analysis_sql()} select query_id, array_to_string(intents, ',') as intents, category, complexity, route, k, round(v3 / (v3 + k3), 6) as vector_weight, array_to_string(variants, '|') as variants from q9")
def q01(spark, sf):
    a = U.analyse(cases(spark, sf))
    return a.select("query_id", F.array_join("intents", ",").alias("intents"), "category", "complexity", "route", "k", F.round("weights.vector", 6).alias("vector_weight"), F.array_join("variants", "|").alias("variants"))


@add("q05_suggestions", f"with {analysis_sql()}, o as (select query_id, list_filter(list_concat(variants, [array_to_string(keywords[1:4], ' ')]), lambda v: v <> query and v <> '') as o from q9), f as (select query_id, (list_filter(o, lambda x, i: list_position(o, x) = i))[1:3] as o from o) select query_id, unnest(range(len(o))) as position, unnest(o) as suggestion from f")
def q05(spark, sf):
    return U.suggestions(U.analyse(cases(spark, sf)))


def class_sql(c: str, classes: list[tuple[str, list[str]]], default: str) -> str:
    return "case " + " ".join(f"when {any_of(c, words)} then '{name}'" for name, words in classes) + f" else '{default}' end"


@add("q08_query_class", f"""with {QUESTIONS}, t as (select *, len(list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1))) as n from q0)
  select query_id, {class_sql('lower(query)', A.RESPONSE_KINDS, 'general')} as kind, {class_sql('lower(query)', A.QUERY_TYPES, 'complex')} as type, {class_sql('query', A.QUESTION_FORMS, 'general')} as form, case when n <= 3 and not contains(query, '?') and not contains(query, '，') then 'simple' when n <= 6 then 'medium' else 'complex' end as complexity, query_id % 2 = 0 as requires_context from t""")
def q08b(spark, sf):
    history = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("before"))).otherwise(F.array().cast("array<string>"))
    return cases(spark, sf).select("query_id", A.response_kind(F.col("query")).alias("kind"), A.query_class(F.col("query"), history).alias("c")).select("query_id", "kind", "c.*")


@add("q14_hyde_variants", f"with {QUESTIONS} select query_id, md5(case when length(trim(query, ' ')) > 6 and lower(trim(query, ' ')) not in ({str(A.GREETINGS)[1:-1]}) then left(trim(repeat(query, 60), ' '), 500) end) as variant from q0")
def q14(spark, sf):
    return cases(spark, sf).select("query_id", F.md5(A.hyde_variant(F.col("query"), F.repeat("query", F.lit(60)))).alias("variant"))


SUPPLEMENTS = [("teacher", 1, ["the", "and"], "standards"), ("teacher", 2, ["ing"], "lesson plan"), ("student", 1, ["tion", "qqq"], "reading list")]


@add("q12_supplements", "with r(perspective, ord, words, suffix) as (values ('teacher', 1, ['the', 'and'], 'standards'), ('teacher', 2, ['ing'], 'lesson plan'), ('student', 1, ['tion', 'qqq'], 'reading list')) select item_id as query_id, perspective, ord, text || ' ' || suffix as query from benchmark join r on len(list_filter(words, lambda w: contains(text, w))) > 0")
def q12(spark, sf):
    rules = spark.createDataFrame(SUPPLEMENTS, "perspective string, ord int, keywords array<string>, suffix string")
    return U.supplemental(load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), rules)


@add("q12_hints", "select item_id as query_id, text || case when contains(text, 'ing') or contains(text, 'tion') then chr(10) || '（' || concat_ws('；', case when contains(text, 'ing') then 'show steps' end, case when contains(text, 'tion') then 'name sources' end) || '）' else '' end as query from benchmark")
def q12b(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), U.with_hints(F.col("text"), [(["ing"], "show steps"), (["tion"], "name sources")]).alias("query"))


@add("q03_q16_rules_on_items", r"""with k as (select item_id, text as q, case when regexp_matches(text, '[A-Za-z]{2,}[\-_/]?[A-Za-z0-9]*|\d+[A-Za-z]+|[A-Za-z]+\d+') then 'technical' else 'general' end as category, length(trim(text)) as n from benchmark),
  a as (select *, case when n <= 8 then greatest(0.3::double, 0.45) when n >= 20 then least(0.3::double, 0.25) else 0.3::double end as k1 from k), b as (select *, case when category = 'technical' then greatest(k1, 0.62) else k1 end as k2 from a),
  c as (select *, case when category = 'technical' then least(k2 + 0.1, 0.6) else k2 end as k3, case when n <= 8 then 0.55::double when n >= 20 then 0.75::double else 0.7::double end as v1 from b),
  d as (select *, case when category = 'technical' then greatest(1.0 - k3, 0.4) else v1 end as v from c)
  select item_id, category, round(v / (v + k3), 6) as vector_weight from d""")
def q16(spark, sf):
    kind = U.category(F.col("text"), F.array().cast("array<string>"))
    return load(spark, sf, "benchmark").select("item_id", kind.alias("category"), F.round(U.adaptive_weights(F.col("text"), kind)["vector"], 6).alias("vector_weight"))


@add("q10_cross_topic", "with p(pattern, ord, a, b, c) as (values ('x', 1, 'the', 'of', 'thing'), ('y', 2, 'and', 'er', 'that')), h as (select item_id as query_id, pattern, ord, contains(text, a)::int + contains(text, b)::int + contains(text, c)::int as n from benchmark cross join p) select query_id, arg_min(pattern, ord) as pattern from h where n >= 2 group by query_id")
def q10(spark, sf):
    p = spark.createDataFrame([("x", 1, ["the", "of", "thing"]), ("y", 2, ["and", "er", "that"])], "pattern string, ord int, keywords array<string>")
    return U.cross_topic(load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), p)


@add("q09_refine", r"""with b as (select item_id, text, case item_id % 4 when 0 then 'similarity' when 1 then 'coverage' when 2 then 'completeness' else 'diversity' end as weakness, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2) as toks from benchmark)
  select item_id, weakness, case weakness when 'similarity' then text || ' more' when 'coverage' then regexp_replace(text, '^(请问|怎么|如何|什么是|please |how (do|does|to) |what (is|are) )', '')
    when 'completeness' then trim(regexp_split_to_array(text, '[，,；;。.?？]|以及|和| and ')[1], ' ') else array_to_string((list_filter(toks, lambda x, i: list_position(toks, x) = i))[1:3], ' ') end as refined from b""")
def q09(spark, sf):
    b = load(spark, sf, "benchmark")
    weak = F.element_at(F.array(*map(F.lit, ["similarity", "coverage", "completeness", "diversity"])), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select("item_id", weak.alias("weakness"), U.refine(F.col("text"), weak, F.lit("more")).alias("refined"))


@add("k01_k02_sections", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
  m as (select *, length(line) < 40 as h from l), s as (select *, sum(h::int) over (partition by doc_id order by pos rows unbounded preceding) as section_no from m)
  select doc_id, cast(section_no as bigint) as section_no, max(line) filter (h) as title, count(*) filter (not h) as n_lines, sum(length(line)) filter (not h) as n_chars from s group by doc_id, section_no having count(*) filter (not h) > 0""")
def k02(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return S.sections(lines, F.length("line") < 40).select("doc_id", "section_no", "title", "n_lines", "n_chars")


@add("k07_fixed_windows", """with w as (select doc_id, text, unnest(range(greatest(ceil((length(text) - 120) / 560.0)::int, 1))) as chunk_no from documents where length(text) > 0) select doc_id, chunk_no, md5(substr(text, (chunk_no * 560 + 1)::int, 680)) as digest from w""")
def k07(spark, sf):
    return S.fixed_windows(load(spark, sf, "documents")).select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@add("k07_k09_sentence_chunks")
def k09(spark, sf):
    return S.chunk_documents(load(spark, sf, "documents"))


#: Where a child of 250 characters that starts after ``st`` of them ends in SQL: after the last of the first mark in its second half.
CUT = "case " + " ".join(f"when strpos(reverse(half), {m}) > 0 then st + 125 + length(half) - strpos(reverse(half), {m}) + 1" for m in ("'。'", "'！'", "'？'", "'；'", "chr(10)", "'.'", "'!'", "'?'", "';'", "' '")) + " else st + 250 end"


def child_sql(start: str) -> str:
    cut = f"select *, case when st + 250 >= length(text) then length(text) else {CUT} end as cut from (select *, substr(text, st + 126, 125) as half from ({start}))"
    return f"select doc_id, text, ord, st, case when length(text) - cut < 80 then length(text) else cut end as fin from ({cut})"


@add("k12_children", f"""with recursive r as ({child_sql('select doc_id, text, 0 as ord, 0::bigint as st from documents where length(text) > 0')} union all {child_sql('select doc_id, text, ord + 1 as ord, greatest(fin - 50, st + 1) as st from r where fin < length(text)')})
  select doc_id as parent_id, ord, md5(substr(text, st + 1, fin - st)) as digest from r""")
def k12(spark, sf):
    return S.children(load(spark, sf, "documents").select(F.col("doc_id").alias("parent_id"), "text")).select("parent_id", "ord", F.md5("text").alias("digest"))


@add("k10_k16_context", "select doc_id, concat_ws('；', source, nullif(lang, 'en'), 'p ' || n_chars) as prefix, md5(concat_ws(' ', source || ' ' || lang, source || ' ' || lang, text)) as search_text from documents")
def k10(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("；", "source", F.nullif("lang", F.lit("en")), F.concat(F.lit("p "), "n_chars")).alias("prefix"), F.md5(S.search_text(F.col("source"), F.col("lang"), F.col("text"))).alias("search_text"))


@add("k13_chunk_quality", r"""with c as (select source as doc_id, doc_id as ord, trim(text, ' ') as t, lang from documents), d as (select *, row_number() over (partition by doc_id, md5(t) order by ord) as nth, right(t, 1) in ('。', '！', '？', '.', ';', '；') as ends, len(regexp_extract_all(t, '\p{L}')) / greatest(length(t), 1)::double as share from c),
  f as (select *, (case when t = '' then 1.0 else 0 end + case when length(t) < 18 then 0.45 else 0 end + case when regexp_matches(t, '[\x{fffd}□◻]|[A-Za-z]{8,}\d{3,}') then 0.25 else 0 end + case when not ends then 0.10 else 0 end + case when nth > 1 and t <> '' then 0.9 else 0 end + case when t <> '' and share < 0.10 then 0.20 else 0 end)::double as loss from d)
  select doc_id, ord, round(greatest(0, least(1, 1 - loss)), 3) as score, case when t = '' or (nth > 1 and t <> '') or greatest(0, 1 - loss) < 0.35 then 'reject' when loss > 0 then 'warn' else 'pass' end as status from f""")
def k13(spark, sf):
    c = load(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), "text", F.col("lang").alias("section_path"))
    return S.assess(c, "latin").select("doc_id", "ord", "score", "status")


@add("a03_a04_cleaning_report", "select source, count(*) as n, count_if(length(text) < 120) as short, count_if(length(text) between 120 and 300) as medium, count_if(length(text) > 300) as long, min(length(text)) as least, max(length(text)) as most, cast(floor(sum(length(text)) / count(*)) as bigint) as mean, grouping(source) as total from documents group by rollup(source)")
def a03(spark, sf):
    n = F.length("text")
    g = load(spark, sf, "documents").rollup("source").agg(F.count("*").alias("n"), F.count_if(n < 120).alias("short"), F.count_if(n.between(120, 300)).alias("medium"), F.count_if(n > 300).alias("long"), F.min(n).alias("least"), F.max(n).alias("most"), F.floor(F.sum(n) / F.count("*")).alias("mean"), F.grouping("source").cast("bigint").alias("total"))
    return g


LEVELS = {"recall": ["cold", "widget"], "apply": ["small", "bolt", "PROMO"], "create": ["large", "ECONOMY"]}
LEVEL_SQL = ", ".join(" + ".join(f"contains(p_name || ' ' || p_type, '{w}')::int" for w in words) + f" as n_{name}" for name, words in LEVELS.items())


@add("k14_bloom_level", f"with s as (select p_partkey, {LEVEL_SQL} from part) select p_partkey, case when greatest(n_recall, n_apply, n_create) = 0 then 'understand' when n_recall >= n_apply and n_recall >= n_create then 'recall' when n_apply >= n_create then 'apply' else 'create' end as level from s")
def k14(spark, sf):
    return load(spark, sf, "part").select("p_partkey", S.bloom_level(F.concat_ws(" ", "p_name", "p_type"), LEVELS, "understand").alias("level"))


@add("a05_structure", "select c_mktsegment, n_regionkey, count(*) as n, round(sum(c_acctbal), 6) as total from customer join nation on c_nationkey = n_nationkey group by grouping sets ((c_mktsegment), (n_regionkey), ())")
def a05(spark, sf):
    j = load(spark, sf, "customer").join(F.broadcast(load(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupingSets([["c_mktsegment"], ["n_regionkey"], []], "c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 6).alias("total"))


@add("a08_percentiles", """with r as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events)
  select event_type, any_value(n) as n, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high, round(max(value) filter (rn = least(floor(n * 0.5::double), n - 1) + 1), 6) as p50, round(max(value) filter (rn = least(floor(n * 0.95::double), n - 1) + 1), 6) as p95, round(max(value) filter (rn = least(floor(n * 0.99::double), n - 1) + 1), 6) as p99 from r group by event_type""")
def a08(spark, sf):
    return M.percentile_stats(load(spark, sf, "events"), ["event_type"], "value")


@add("a09_statistics", """with u as (select max(ts) as u from events), r(range, hours) as (values ('1h', 1), ('24h', 24), ('7d', 168), ('all', 10000000))
  select range, event_type, count(*) as n, round(avg(value), 6) as mean, count_if(value > 100) as slow from events cross join u join r on range = 'all' or ts > u - to_hours(hours) group by all""")
def a09(spark, sf):
    e = load(spark, sf, "events")
    until = e.agg(F.max("ts").alias("until"))
    return M.statistics(e.crossJoin(F.broadcast(until)), F.col("until"), {"1h": 1, "24h": 24, "7d": 168, "all": None})


@add("i03_cache", """with q as (select vec_id as query_id, 'k' || (vec_id // 2) as key, embedding::double[] as vector from embeddings where vec_id % 20 = 0), e as (select 'k' || vec_id as key, embedding::double[] as vector, vec_id % 3 as ttl from embeddings where label < 3 and vec_id % 5 <> 0),
  live as (select * from e where ttl <> 1), x as (select query_id, key, 'exact' as kind, 1.0 as similarity from q where key in (select key from live)),
  s as (select query_id, live.key, round(list_cosine_similarity(q.vector, live.vector), 6) as similarity from q cross join live where query_id not in (select query_id from x)), b as (select *, row_number() over (partition by query_id order by similarity desc, key) as rn from s where similarity >= 0.2)
  select * from x union all select query_id, key, 'similar', similarity from b where rn = 1""")
def i03(spark, sf):
    e = load(spark, sf, "embeddings")
    asked_ = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("k"), F.expr("vec_id div 2")).alias("key"), F.col("embedding").alias("vector"))
    entries = e.where("label < 3 and vec_id % 5 <> 0").select(F.concat(F.lit("k"), "vec_id").alias("key"), F.col("embedding").alias("vector"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), (F.col("vec_id") % 3).cast("int").alias("ttl"))
    # a ttl of 1 has ended, one of 2 goes on until the second is over
    return M.cached(asked_, entries, F.lit("2024-01-01 00:00:01").cast("timestamp"), 0.2)


@add("x07_insert", "with e as (select user_id as key, count(*) as h, max(ts) as t from events group by user_id), m as (select key, case when key % 3 = 0 then 1000 else h end as h, t from e) select key, h as hit_count from m order by h desc, t desc, key limit 40")
def x07(spark, sf):
    e = load(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("hit_count"), F.max("ts").alias("ts"))
    return M.insert(e, e.where("key % 3 = 0").withColumn("hit_count", F.lit(1000).cast("bigint")), 40).select("key", "hit_count")


@add("a14_cache_statistics", "with e as (select user_id, count(*) as h from events group by user_id) select count(*) as total_entries, round(count(*) / 500.0, 6) as usage_ratio, sum(h) as total_hits, round(avg(h), 6) as avg_hits, max(h) as max_hits from e")
def a14(spark, sf):
    return M.cache_statistics(load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("hit_count")), 500)


@add("x01_append", """with s as (select conv_id as session_id, max(turn) as updated_at, list(text order by turn) as messages from conversations where turn < 3 group by conv_id), n as (select conv_id as session_id, max(turn) as last, list(text order by turn) as more from conversations where turn >= 3 group by conv_id)
  select s.session_id, greatest(updated_at, coalesce(last, updated_at)) as updated_at, md5(array_to_string(case when more is null then messages else list_concat(messages, more) end, '|')) as messages from s left join n using (session_id)""")
def x01(spark, sf):
    c = load(spark, sf, "conversations")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    old = c.where("turn < 3").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("updated_at"), ordered.alias("messages"))
    new = c.where("turn >= 3").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.col("text").alias("message"))
    return M.append_message(old, new).withColumn("messages", F.md5(F.array_join("messages", "|")))


@add("x01_revoked", "select count_if(user_id % 4 = 0 and event_type <> 'error') as changed from events")
def x01b(spark, sf):
    tokens = load(spark, sf, "events").withColumn("is_revoked", F.col("event_type") == "error")
    return M.revoke(tokens, F.col("user_id") % 4 == 0)[1]


@add("x02_listing", "select event_id, user_id, ts from events where user_id = 7 order by ts desc, event_id")
def x02(spark, sf):
    return M.listing(load(spark, sf, "events").select("event_id", "user_id", "ts"), F.col("user_id") == 7, "ts", "event_id")


@add("x08_cache_keys", """select item_id, '{"query":' || to_json(text) || ',"top_k":5,"use_keyword":true,"use_vector":null}' as key from benchmark""")
def x08(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", M.candidate_key(F.col("text"), 5, None, True).alias("key"))


@add("s16_enriched", "select c_custkey, n_name, n_regionkey, r_name from customer left join (select n_nationkey, n_name, n_regionkey, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0) on c_nationkey = n_nationkey")
def s16(spark, sf):
    facts = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey", "r_name")
    return M.enriched(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), facts, "c_nationkey").drop("c_nationkey")


@add("a10_http_counters", "select event_type, extract('hour' from ts) as hour, count(*) as n, count_if(event_type = 'error') as errors, round(sum(value), 4) as total from events group by all")
def a10(spark, sf):
    return load(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total"))


@add("a12_level_shares", "select event_type, count(*) as n, round(count(*) * 100.0::double / (select count(*) from events), 6) as percent from events group by event_type")
def a12(spark, sf):
    return M.shares(load(spark, sf, "events"), "event_type")


@add("s15_prometheus", """select 'events_total{type="' || event_type || '"} ' || count(*) as line from events group by event_type""")
def s15(spark, sf):
    n = load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return M.prometheus(n.select(F.lit("events_total").alias("name"), F.col("event_type").alias("label"), "value"))


@add("w07_last_points", "select event_type, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as b from events) where b <= 100")
def w07(spark, sf):
    return M.last_points(load(spark, sf, "events"), "event_type", 100).select("event_type", "event_id")


@add("i01_changes", "with o as (select doc_id, sha256(text) as h from documents where doc_id % 7 <> 0), n as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as h from documents where doc_id % 11 <> 0) select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.h is null then 'added' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'modified' end as status from o full join n using (doc_id)")
def i01(spark, sf):
    """Two snapshots made from one table."""
    return M.changes(*snapshots(spark, sf))


def snapshots(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return d.where("doc_id % 7 <> 0"), d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@add("i02_update_index", """with o as (select doc_id, text from documents where doc_id % 7 <> 0), n as (select doc_id, case when doc_id % 5 = 0 then text || '!' else text end as text from documents where doc_id % 11 <> 0),
  keep as (select doc_id, o.text from o join n using (doc_id) where sha256(o.text) = sha256(n.text)), fresh as (select n.doc_id, n.text from n left join o using (doc_id) where o.doc_id is null or sha256(o.text) <> sha256(n.text)), u as (select * from keep union all select * from fresh),
  w as (select doc_id, text, unnest(range(greatest(ceil((length(text) - 120) / 560.0)::int, 1))) as chunk_no from u where length(text) > 0) select doc_id, chunk_no, md5(substr(text, (chunk_no * 560 + 1)::int, 680)) as digest from w""")
def i02(spark, sf):
    old, new = snapshots(spark, sf)
    return M.update_index(S.fixed_windows(old), M.changes(old, new), S.fixed_windows(new)).select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@add("i04_eviction", "select user_id as key from (select user_id, count(*) as h, max(ts) as t from events group by user_id) order by h desc, t desc, user_id limit 50")
def i04(spark, sf):
    e = load(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("hit_count"), F.max("ts").alias("ts"))
    return M.evict(e, 50).select("key")


@add("s09_upsert", "select doc_id, source from documents where doc_id % 3 <> 0 union all select doc_id, 'new' from documents where doc_id % 3 = 0")
def s09(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source")
    return M.upsert(d, d.where("doc_id % 3 = 0").withColumn("source", F.lit("new")), "doc_id")


@add("s09_deleted", "select source, count(*) as n from documents where doc_id not in (select doc_id from labels where toxic = 1) group by source")
def s09b(spark, sf):
    gone = load(spark, sf, "labels").where("toxic = 1")
    return M.deleted(load(spark, sf, "documents").select("doc_id", "source"), gone, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@add("x06_snapshot", """select event_type as name, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high, arg_max(value, (ts, value)) as last, count_if(case when event_id % 3 = 0 then value > 3.0 when event_id % 3 = 1 then value > 1.5 else value > 2.0 end) as slow from events group by event_type""")
def x06b(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "query").when(F.col("event_id") % 3 == 1, "retrieval").otherwise("generation")
    return M.snapshot(load(spark, sf, "events").select(F.col("event_type").alias("name"), "ts", "value", kind.alias("kind")))


@add("s03_synthetic_pages", "with r as (select source, n_chars, row_number() over (partition by source order by doc_id) as rn from documents) select source, cast(floor((rn - 1) / 45) + 1 as int) as page, count(*) as n, sum(n_chars) as chars from r group by all")
def s03(spark, sf):
    paged = readers.synthetic_pages(load(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")
    return paged.groupBy("source", "page").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@add("s02_clean_lines", r"""with l as (select source as path, doc_id as page, unnest(string_split(text, chr(10))) as line from documents), c as (select path, page, trim(regexp_replace(trim(regexp_replace(replace(replace(line, '•', ' '), '　', ' '), '\s+', ' ', 'g'), ' '), '^[| ]+|[| ]+$', '', 'g'), ' ') as line from l)
  select path, page, count(*) as n, sum(length(line)) as chars from c where line <> '' and not (regexp_matches(line, '^\s*$|^\d+$|^[·•.．…\-_]{4,}$|^[\d\s\-_/]+$') or length(line) <= 2 or length(line) - length(replace(line, '…', '')) >= 3 or length(line) - length(replace(line, '.', '')) >= 8 or starts_with(line, '第 '))
    and not (regexp_matches(line, '[.．…]{4,}\s*\d+$') or (contains(line, '目录') and length(line) <= 12)) group by all""")
def s02(spark, sf):
    lines_ = load(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.clean_page_lines(lines_).groupBy("path", "page").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@add("s03_table_rows", "with p as (select p_partkey, [trim(p_brand, ' '), trim(p_type, ' '), '', trim(p_brand, ' '), trim(p_name, ' ')] as c from part), f as (select p_partkey, list_filter(c, lambda x: x <> '') as c from p) select p_partkey, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ' | ') as line from f")
def s03b(spark, sf):
    return load(spark, sf, "part").select("p_partkey", readers.table_row(F.array("p_brand", "p_type", F.lit(" "), "p_brand", "p_name")).alias("line"))


@add("s07_metadata", r"with t as (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark) select term, count(*) as n from t where length(term) >= 2 group by term order by n desc, term limit 100")
def s07(spark, sf):
    return readers.top_keywords(load(spark, sf, "benchmark").select("text"))


@add("s10_find_many", "select doc_id, lang, n_chars from documents where lang = 'fr' order by n_chars desc, doc_id limit 20 offset 10")
def s10(spark, sf):
    return load(spark, sf, "documents").where("lang = 'fr'").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(20)


@add("s13_point_lookup", "select doc_id, source, lang from documents where doc_id = 17")
def s13(spark, sf):
    return load(spark, sf, "documents").where("doc_id = 17").select("doc_id", "source", "lang")


@add("s12_x03_sessions", "select conv_id, count(*) as messages, count(distinct role) as roles, max(turn) as last_turn, arg_min(substr(text, 1, 20), turn) as title from conversations group by conv_id")
def s12(spark, sf):
    return M.sessions(load(spark, sf, "conversations"))


@add("s17_memory", "select user_id, event_type, arg_max(props, (ts, event_id)) as content from events group by all")
def s17(spark, sf):
    e = load(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return M.latest(e, ["user_id", "event_type"], "o", "props").withColumnRenamed("props", "content")


@add("s11_unique_keys", "select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1 union all select l_orderkey, null, count(*) from (select l_orderkey, l_linenumber from lineitem) group by l_orderkey, l_linenumber having count(*) > 1")
def s11(spark, sf):
    li = load(spark, sf, "lineitem")
    broken = M.broken_unique(li, ["l_orderkey", "l_partkey"])
    return broken.unionByName(M.broken_unique(li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.lit(None).cast("bigint").alias("l_partkey"), "n"))


@add("v04_history_search", "select distinct conv_id from conversations where contains(lower(text), 'that')")
def v04(spark, sf):
    return load(spark, sf, "conversations").where(F.contains(F.lower("text"), F.lit("that"))).select("conv_id").distinct()


@add("v05_day_buckets", "select case when d <= 0 then 'today' when d = 1 then 'yesterday' when d <= 7 then 'last 7 days' else 'earlier' end as bucket, count(*) as n from (select date_diff('day', ts::date, date '2024-01-30') as d from events) group by 1")
def v05(spark, sf):
    return load(spark, sf, "events").groupBy(M.day_bucket(F.col("ts"), F.lit("2024-01-30").cast("date")).alias("bucket")).agg(F.count("*").alias("n"))


@add("v06_balance", "select user_id, round(sum(case when event_type = 'purchase' then value else 0 end), 6) as income, round(sum(case when event_type = 'error' then value else 0 end), 6) as expense from events group by user_id")
def v06(spark, sf):
    s = lambda t: F.round(F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)), 6)
    return load(spark, sf, "events").groupBy("user_id").agg(s("purchase").alias("income"), s("error").alias("expense"))


@add("x06_slow_flags", "select event_type, count_if(case event_type when 'click' then value / 20 > 3.0 when 'view' then value / 20 > 1.5 when 'purchase' then value / 20 > 2.0 else false end) as slow from events group by event_type")
def x06(spark, sf):
    kind = F.create_map(*map(F.lit, ["click", "query", "view", "retrieval", "purchase", "generation"]))
    return load(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.coalesce(M.slow(F.try_element_at(kind, F.col("event_type")), F.col("value") / 20), F.lit(False))).alias("slow"))


def part_edges(spark, sf):
    """Parts of an order, in line order, as the items of a group."""
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_partkey").alias("item"))


HIER = "e as (select n_regionkey as src, 100 + n_nationkey as dst from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer)"


def hierarchy(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_regionkey").cast("bigint").alias("src"), (F.col("n_nationkey") + 100).cast("bigint").alias("dst"))
    return n.unionByName(load(spark, sf, "customer").select((F.col("c_nationkey") + 100).cast("bigint").alias("src"), (F.col("c_custkey") + 1000).alias("dst")))


@add("g04_co_occurrence", "select least(a.l_partkey, b.l_partkey) as x, greatest(a.l_partkey, b.l_partkey) as y, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber - a.l_linenumber between 1 and 7 and a.l_partkey <> b.l_partkey group by all")
def g04(spark, sf):
    return G.co_occurrence(part_edges(spark, sf))


@add("g06_reach", f"with recursive {HIER}, r as (select 1::bigint as seed, 1::bigint as node, 0 as depth union select seed, e.dst, depth + 1 from r join e on e.src = r.node where depth < 3) select seed, node, min(depth) as depth from r group by all")
def g06(spark, sf):
    return G.reach(hierarchy(spark, sf), spark.createDataFrame([(1,)], "seed bigint"), 3)


@add("g07_paths", f"with recursive {HIER}, g as (select unnest([0, 1, 2, 3, 4]) as seed, 1001 as goal), r as (select seed, goal, seed::bigint as node, 0 as depth, seed::varchar as path from g union all select seed, goal, e.dst, depth + 1, path || '>' || e.dst from r join e on e.src = r.node where depth < 3 and node <> goal) select seed, goal, depth, min(path) as path from r where node = goal group by all")
def g07(spark, sf):
    p = G.shortest_paths(hierarchy(spark, sf), spark.createDataFrame([(0, 1001), (1, 1001), (2, 1001), (3, 1001), (4, 1001)], "seed bigint, goal bigint"), 3)
    return p.select("seed", "goal", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@add("g10_components", f"with {HIER}, r as (select src as id, src as community from e where src < 100 union select dst, src from e where src < 100 union select e2.dst, e1.src from e e1 join e e2 on e2.src = e1.dst) select id, min(community) as community from r group by id")
def g10(spark, sf):
    return G.components(hierarchy(spark, sf))


@add("g10_community_search", """with n as (select p_partkey as id, p_name as name, p_brand as community, row_number() over (partition by p_brand order by p_partkey) as rn from part), s as (select community, count(*) as size, string_agg(name, '、' order by id) filter (rn <= 10) as summary from n group by community),
  q(query_id, kw) as (values (1, ['cold', 'bolt']), (2, ['widget', 'large']), (3, ['zzzz'])), h as (select query_id, community, size, len(list_filter(kw, lambda w: contains(lower(summary), w))) as hits from s cross join q),
  r as (select *, row_number() over (partition by query_id order by hits desc, size desc, community) as rank from h where hits > 0) select query_id, community, round(least(0.95, 0.7 + 0.1 * hits)::double, 6) as score, rank from r where rank <= 5""")
def g10b(spark, sf):
    part = load(spark, sf, "part")
    queries = spark.createDataFrame([(1, ["cold", "bolt"]), (2, ["WIDGET", "large"]), (3, ["zzzz"])], "query_id int, keywords array<string>")
    summaries = G.community_summaries(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community")))
    return G.search_communities(queries, summaries)


@add("g11_gaps", "with s as (select l_partkey, l_suppkey from lineitem where l_quantity > 47) select p_partkey as requirement, count(distinct l_suppkey) as supporters, case when count(distinct l_suppkey) = 0 then 'high' else 'medium' end as severity from part left join s on l_partkey = p_partkey group by p_partkey having count(distinct l_suppkey) < 2")
def g11(spark, sf):
    strong = load(spark, sf, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("requirement"), F.col("l_suppkey").alias("supporter"))
    return G.coverage_gaps(load(spark, sf, "part").select(F.col("p_partkey").alias("requirement")), strong, 2)


@add("g11_orphans", f"with {HIER}, n as (select n_nationkey + 100 as id from nation where n_nationkey % 2 = 0), x as (select src as id from e union select dst from e) select id from x where id not in (select id from n)")
def g11b(spark, sf):
    return G.orphans(hierarchy(spark, sf), load(spark, sf, "nation").where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 100).cast("bigint").alias("id")))


@add("g05_seeds", "with q(query_id, term) as (values (1, 'steel'), (2, 'a'), (3, 'an')), h as (select query_id, p_partkey as id, row_number() over (partition by query_id order by p_partkey) as rn from q join part on contains(lower(p_type), term) where length(term) >= 2) select * from h where rn <= 10")
def g05(spark, sf):
    q = spark.createDataFrame([(1, "steel"), (2, "a"), (3, "an")], "query_id int, term string")
    return G.find_nodes(q, load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")))


@add("g09_chain", f"with {HIER}, f as (select src, min(dst) as dst from e group by src) select r_regionkey::bigint as id, a.dst || coalesce('>' || b.dst, '') as chain from region join f a on a.src = r_regionkey left join f b on b.src = a.dst")
def g09(spark, sf):
    return G.chain(hierarchy(spark, sf), load(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("id")))


@add("v01_degrees", f"with {HIER} select id, count(*) as degree from (select src as id from e union all select dst from e) group by id order by degree desc, id limit 6")
def v01(spark, sf):
    return G.degrees(hierarchy(spark, sf)).orderBy(F.desc("degree"), "id").limit(6)


@add("v02_last_edges", "select src, dst, type, ord from (select user_id as src, user_id % 7 as dst, event_type as type, event_id as ord, row_number() over (partition by user_id, user_id % 7, event_type order by event_id desc) as rn from events) where rn = 1")
def v02(spark, sf):
    return G.last_edges(load(spark, sf, "events").select(F.col("user_id").alias("src"), (F.col("user_id") % 7).alias("dst"), F.col("event_type").alias("type"), F.col("event_id").alias("ord")))


@add("g03_same_category", """with e as (select p_partkey as src, p_partkey + 1 as dst from part where p_partkey % 4 = 0), p as (select a.p_partkey as src, b.p_partkey as dst from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey)
  select p.src, p.dst, 0.3 as weight from p left join e on (e.src = p.src and e.dst = p.dst) or (e.src = p.dst and e.dst = p.src) where e.src is null""")
def g03(spark, sf):
    part = load(spark, sf, "part")
    edges = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return G.same_category(part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), "p_size").alias("category")), edges, "category")  # null if either is: such parts have no pair


@add("g03_members", "with m as (select p_brand as category, p_partkey as id, count(*) over (partition by p_brand) as n from part) select category, id, n - 1 as links from m where n > 1")
def g03b(spark, sf):
    return G.category_members(load(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand").withColumnRenamed("p_brand", "category")


@add("g11_overlaps", "select l_partkey as concept, count(distinct l_suppkey) as courses, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as names from lineitem group by l_partkey having count(distinct l_suppkey) >= 3")
def g11c(spark, sf):
    return G.overlaps(load(spark, sf, "lineitem").select(F.col("l_partkey").alias("concept"), F.col("l_suppkey").cast("string").alias("course")), 3)


@add("g14_context_cards", f"""with {HIER}, n as (select r_regionkey::bigint as id, r_name as name from region union all select 100 + n_nationkey, n_name from nation), d as (select src, dst, row_number() over (partition by src order by dst) as rn from e where src < 100),
  g as (select src, string_agg(name, '、' order by dst) as names from d join n on n.id = dst where rn <= 4 group by src) select n.id, '[' || name || '] 后续课程：' || names as card from g join n on n.id = src""")
def g14(spark, sf):
    region, nation = load(spark, sf, "region"), load(spark, sf, "nation")
    nodes = region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")).unionByName(nation.select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_name").alias("name")))
    return G.cards(nodes, hierarchy(spark, sf).where("src < 100"), "后续课程", 4)


@add("x10_subgraph_summary", """with n as (select p_brand as grp, p_partkey as id, p_name as name, case p_size % 3 when 0 then 'course' when 1 then 'concept' else 'requirement' end as type from part), r as (select *, row_number() over (partition by grp, type order by id) as rn from n),
  g as (select grp, string_agg(name, '、' order by id) filter (type = 'course' and rn <= 6) as c, string_agg(name, '、' order by id) filter (type = 'concept' and rn <= 10) as k, string_agg(name, '、' order by id) filter (type = 'requirement' and rn <= 5) as q from r group by grp)
  select grp, concat_ws(chr(10), '[图谱检索结果]', '涉及课程：' || c, '核心知识点：' || k, '关联毕业要求：' || q) as summary from g""")
def x10(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "course").when(F.col("p_size") % 3 == 1, "concept").otherwise("requirement")
    return G.summarise(load(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("type")), "grp")


@add("g06_capped_subgraph", f"with recursive {HIER}, u as (select src, dst from e union select dst, src from e), r as (select 0::bigint as seed, 0::bigint as node, 0 as depth union select seed, u.dst, depth + 1 from r join u on u.src = r.node where depth < 2), f as (select seed, node, min(depth) as depth from r group by all), k as (select *, row_number() over (partition by seed order by depth, node) as rn from f) select seed, node, depth from k where rn <= 40")
def g06b(spark, sf):
    return G.neighbourhood(hierarchy(spark, sf), spark.createDataFrame([(0,)], "seed bigint"), 2, 40)


@add("g08_learning_path", f"with recursive {HIER}, up as (select 1001::bigint as node, 0 as depth union select e.src, depth - 1 from up join e on e.dst = up.node where depth > -3), down as (select 1::bigint as node, 0 as depth union select e.dst, depth + 1 from down join e on e.src = down.node where depth < 3) select 1001::bigint as target, node, min(depth) as depth from up group by node union all select 1, node, min(depth) from down group by node")
def g08(spark, sf):
    e = hierarchy(spark, sf)
    targets = spark.createDataFrame([(1001,), (1,)], "seed bigint")
    return G.learning_path(e, targets, 3).withColumnRenamed("seed", "target")


@add("st1_tumbling_batch", "select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(sum(value), 4) as total from events group by all")
def st1(spark, sf):
    from corpusloom.streaming import windows

    return windows.tumbling(load(spark, sf, "events"))


@add("st2_sessions_batch", """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
  select user_id, min(ts) as start, count(*) as n from s group by user_id, sid""")
def st2(spark, sf):
    from corpusloom.streaming import windows

    return windows.sessionised(load(spark, sf, "events"))


@add("s06_load_normalise", "select doc_id, coalesce(nullif(trim(source), ''), 'unknown') as section, length(text) as char_count from documents where length(text) >= 40")
def s06(spark, sf):
    return readers.normalised(load(spark, sf, "documents").select(F.col("doc_id"), "text", F.col("source").alias("section")))
