"""Queries over the cleaning and extraction functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.registry import REGISTRY
from corpusloom.session import load

add = REGISTRY.add
W = r"[\p{L}\p{N}]+"
LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@add("c01_collapse", r"select doc_id, trim(regexp_replace(replace(text, '　', ' '), '\s+', ' ', 'g')) as clean from documents")
def c01(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("clean"))


@add("c03_scrub", r"select doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(12), chr(10) || chr(10)), '[\x00-\x08\x0b\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as digest from documents")
def c03(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.scrub(F.col("text"))).alias("digest"))


@add(
    "c06_c09_line_predicates",
    r"with " + LINES + r""", f as (select doc_id, line, length(line) as n,
      regexp_matches(line, '[.．…]{4,}\s*\d+$') or (contains(line, '目录') and length(line) <= 12) as toc,
      regexp_matches(line, '^(第\s*\d+\s*页|\d+\s*/\s*\d+|(?i:目录|contents))$') as page_noise,
      regexp_matches(line, '^\s*$|^\d+$|^[·•.．…\-_]{4,}$|^[\d\s\-_/]+$') or length(line) <= 2 or length(line) - length(replace(line, '…', '')) >= 3
        or length(line) - length(replace(line, '.', '')) >= 8 or starts_with(line, '第 ') as noise,
      (len(regexp_extract_all(line, '\b\d+(\.\d+)?\b')) >= 8 and len(regexp_extract_all(line, '\p{L}')) < 20) or length(line) - length(replace(line, '|', '')) >= 3
        or regexp_matches(line, '[1-9]\s+[1-9]\s+[1-9]') as table_like,
      regexp_matches(line, '\bpublic\s+class\b|\bSystem\.out\.println\b|\bimport\s+java\.|https?://|\b[A-Za-z_][A-Za-z0-9_]*\s*\(|[{};<>]{3,}')
        or regexp_matches(line, '^(package |class |public |private |protected )')
        or (length(line) - length(replace(line, '=', '')) >= 2 and len(regexp_extract_all(line, '\p{L}')) < 10) as code
      from lines)
    select doc_id, count(*) as n_lines, count_if(toc) as n_toc, count_if(page_noise) as n_page_noise, count_if(noise) as n_noise, count_if(table_like) as n_table, count_if(code) as n_code from f group by doc_id""",
)
def c06(spark, sf):
    c, n = F.col("line"), lambda x: F.count_if(x)
    return lines(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), n(T.toc_line(c)).alias("n_toc"), n(T.page_noise(c)).alias("n_page_noise"), n(T.corpus_noise(c)).alias("n_noise"),
        n(T.table_like(c, "latin")).alias("n_table"), n(T.code_like(c, "latin")).alias("n_code"),
    )


@add(
    "c11_low_signal",
    r"""with f as (select doc_id, greatest(length(text), 1) as n, len(regexp_extract_all(text, '\p{L}')) as own, len(regexp_extract_all(text, '[A-Za-z]')) as latin, len(regexp_extract_all(text, '\d')) as digits from documents)
    select doc_id, own < 40 or latin > own * 1.2 or (own / n < 0.12 and latin / n > 0.18) or (digits / n > 0.35 and own / n < 0.2) as low_signal from f""",
)
def c11(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.low_signal(F.col("text"), "latin").alias("low_signal"))


@add("c12_deep_clean", r"""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(replace(x, '　', ' '), '[\t ]{2,}', ' ', 'g'), ' ')) as l from documents),
  f as (select doc_id, list_filter(l, lambda line: length(line) > 0 and not (regexp_matches(line, '^[\d\s.,\-—_，、:：/]+$') or regexp_matches(line, '^[.\s…⋯·•]+$') or regexp_matches(line, '^[|:：\-_=+/\\\s]+$') or regexp_matches(line, '^\d+[.、，]\s*[^\x{4e00}-\x{9fff}]{0,40}$') or (ends_with(line, '......................') and length(line) < 100)
      or (regexp_matches(line, '^[a-zA-Z0-9][^\x{4e00}-\x{9fff}]{0,50}$') and len(regexp_extract_all(line, '[\x{4e00}-\x{9fff}]')) < 5 and length(line) < 50))
    and not (contains(line, '课程体系与毕业要求') or len(regexp_extract_all(line, '[√✓✔☑□■◆●○]')) >= 2 or (len(regexp_extract_all(line, '[√✓✔☑□■◆●○]')) >= 1 and length(line) - length(replace(line, '|', '')) + len(regexp_extract_all(line, '\s{2,}')) >= 2)
      or (contains(line, '|') and len(regexp_extract_all(line, '[\x{4e00}-\x{9fff}]')) < length(line) * 0.45) or (length(line) - length(replace(line, '|', '')) + len(regexp_extract_all(line, '\s{2,}')) >= 3 and len(regexp_extract_all(line, '[\x{4e00}-\x{9fff}]')) < 14))) as k from l)
  select doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), chr(10)) as clean from f""")
def c12(spark, sf):
    """Lines keep their first occurrence in the array itself, so nothing is shuffled."""
    return load(spark, sf, "documents").select("doc_id", T.deep_clean(F.col("text")).alias("clean"))


@add(
    "c13_c15_noise_rules",
    r"with " + LINES + r""", t as (select doc_id, trim(line) as line from lines)
    select doc_id, count_if(regexp_matches(line, '^[\d\s.,\-—_，、:：/]+$') or regexp_matches(line, '^[.\s…⋯·•]+$') or regexp_matches(line, '^[|:：\-_=+/\\\s]+$')
        or regexp_matches(line, '^\d+[.、，]\s*[^\x{4e00}-\x{9fff}]{0,40}$') or (ends_with(line, '......................') and length(line) < 100)
        or (regexp_matches(line, '^[a-zA-Z0-9][^\x{4e00}-\x{9fff}]{0,50}$') and len(regexp_extract_all(line, '[\x{4e00}-\x{9fff}]')) < 5 and length(line) < 50)) as n_noise,
      count_if(length(line) > 0 and (len(regexp_extract_all(line, '[√✓✔☑□■◆●○]')) >= 2 or (contains(line, '|') and len(regexp_extract_all(line, '\p{L}')) < length(line) * 0.45))) as n_marked,
      max(length(regexp_replace(line, '^\s*(\d+[.、，]\s*|[一二三四五六七八九十]+、\s*)', ''))) as longest from t group by doc_id""",
)
def c13(spark, sf):
    c = F.col("line")
    own = T.count(c, T.SCRIPT["latin"])
    marked = (F.length(c) > 0) & ((T.count(c, T.CHECK_MARK) >= 2) | (c.contains("|") & (own < F.length(c) * 0.45)))
    return lines(spark, sf).withColumn("line", F.trim("line")).groupBy("doc_id").agg(F.count_if(T.noise_line(c)).alias("n_noise"), F.count_if(marked).alias("n_marked"), F.max(F.length(T.without_prefix(c))).alias("longest"))


@add(
    "c16_validity",
    r"""with f as (select doc_id, length(text) as n, len(regexp_extract_all(text, '\p{L}')) as own, len(list_distinct(regexp_extract_all(text, '(?s).'))) as kinds from documents)
    select doc_id, n >= 20 and own >= 8 and kinds >= greatest(n * 0.2, 6.0) as valid, n between 80 and 3000 and own >= 20 and kinds >= n * 0.25 as strict from f""",
)
def c16(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.valid_content(F.col("text"), "latin").alias("valid"), T.valid_strict(F.col("text"), "latin").alias("strict"))


@add(
    "c18_low_quality",
    r"""with f as (select doc_id, text, length(text) as n, length(text) - length(translate(text, '，。；：,.?!！？、/ ', '')) as marks, len(list_distinct(regexp_extract_all(text, '(?s).'))) as kinds from documents)
    select doc_id from f where n < 12 or text = 'x' or (marks / greatest(n, 1) > 0.55 and kinds < 18)""",
)
def c18(spark, sf):
    return load(spark, sf, "documents").where(T.low_quality(F.col("text"), F.lit("x"))).select("doc_id")


@add(
    "c19_mask_secrets",
    r"""select event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)password["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'password: ***', 'g'), '(?i)token["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'token: ***', 'g'),
      '(?i)secret["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'secret: ***', 'g'), '(?i)api_key["'']?\s*[:=]\s*["'']?[^"''\s,}]+', 'api_key: ***', 'g') as masked
    from (select event_id, 'Token=' || event_id || ', "api_key": "k' || user_id || '" password : p' || event_id as s from events)""",
)
def c19(spark, sf):
    raw = F.concat(F.lit("Token="), "event_id", F.lit(', "api_key": "k'), "user_id", F.lit('" password : p'), "event_id")
    return load(spark, sf, "events").select("event_id", T.mask_secrets(raw).alias("masked"))


@add("c20_last_sentence", r"select doc_id, md5(case when regexp_extract(text, '(?s)^(.*[.!?])', 1) = '' then text else regexp_extract(text, '(?s)^(.*[.!?])', 1) end) as digest from documents")
def c20(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.to_last_sentence(F.col("text"), ".!?")).alias("digest"))


@add("t01_tokens", rf"select doc_id, len(regexp_extract_all(lower(text), '{W}')) as n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '{W}'), ' ')) as digest from documents")
def t01(spark, sf):
    return load(spark, sf, "documents").withColumn("t", T.tokens(F.col("text"))).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@add(
    "t02_top_keywords",
    rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '{W}')) as tok, unnest(range(len(regexp_extract_all(lower(text), '{W}')))) as pos from documents),
    c as (select doc_id, tok, count(*) as n, min(pos) as first from t where length(tok) >= 2 group by all),
    r as (select *, row_number() over (partition by doc_id order by n desc, first) as rk from c)
    select doc_id, rk as position, tok as keyword, n as occurrences from r where rk <= 8""",
)
def t02(spark, sf):
    from pyspark.sql import Window

    t = load(spark, sf, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "tok")).where("length(tok) >= 2")
    c = t.groupBy("doc_id", "tok").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return c.withColumn("rk", F.row_number().over(w)).where("rk <= 8").select("doc_id", F.col("rk").alias("position"), F.col("tok").alias("keyword"), F.col("n").alias("occurrences"))


@add(
    "t03_first_keywords",
    rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '{W}')) as tok, unnest(range(len(regexp_extract_all(lower(text), '{W}')))) as pos from documents),
    d as (select doc_id, tok, min(pos) as first from t where length(tok) >= 2 group by all), r as (select *, row_number() over (partition by doc_id order by first) as rk from d)
    select doc_id, string_agg(tok, ' ' order by rk) as keywords from r where rk <= 8 group by doc_id""",
)
def t03(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(T.first_keywords(F.col("text")), " ").alias("keywords")).where("keywords <> ''")


@add("t06_half_width", r"""select item_id, trim(regexp_replace(translate('（' || text || '）：“x”', '（）：；！？，．【】“”‘’''''', '():;!?,.[]'), '\s+', ' ', 'g')) as clean from benchmark""")
def t06(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", T.half_width(F.concat(F.lit("（"), "text", F.lit("）：“x”"))).alias("clean"))


@add(
    "t07_sentences",
    r"""with s as (select doc_id, unnest(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]?')) as s from documents), t as (select doc_id, trim(s) as s from s)
    select doc_id, count(*) as n_sentences, sum(length(s)) as n_chars from t where length(s) >= 12 group by doc_id""",
)
def t07(spark, sf):
    s = load(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@add(
    "t09_truncate",
    r"""with h as (select doc_id, text, left(text, 200) as h from documents),
    p as (select *, case when strpos(reverse(h), '.') > 0 then length(h) - strpos(reverse(h), '.') + 1 else 0 end as a, case when strpos(reverse(h), ' ') > 0 then length(h) - strpos(reverse(h), ' ') + 1 else 0 end as b from h)
    select doc_id, case when length(text) <= 200 then text else rtrim(case when a >= 200 * 0.55::double then left(h, a) when b >= 200 * 0.55::double then left(h, b) else h end, ' ') end as short from p""",
)
def t09(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.truncate_at_boundary(F.col("text"), 200, [".", " "]).alias("short"))


@add("t14_hashes", "select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def t14(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@add("t13_t15_t18_names", r"select p_partkey, lower(regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9\x{4e00}-\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug, lower(regexp_replace(p_name, '\s+', '', 'g')) as concept, left(array_to_string(regexp_extract_all(p_type, '\p{L}'), ''), 80) as print from part")
def t15(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), T.concept_id(F.col("p_name")).alias("concept"), T.script_fingerprint(F.col("p_type"), "latin").alias("print"))


@add("t16_levenshtein", "select a.p_partkey as a, b.p_partkey as b, round(1.0 - levenshtein(a.p_type, b.p_type) / greatest(length(a.p_type), length(b.p_type)), 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def t16(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_type")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_type").alias("x"), (F.col("p_partkey") + 1).alias("b")), p.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(T.similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@add(
    "t19_paths",
    r"""with p as (select page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) || '/' || md5(url) as path from pages)
    select page_id, '/' || array_to_string(list_transform(string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/'), lambda x: case when length(x) > 20 or (length(x) > 8 and contains(x, '-')) then '{id}' else x end), '/') as path from p""",
)
def t19(spark, sf):
    path = F.concat(F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1), F.lit("/"), F.md5("url"))
    return load(spark, sf, "pages").select("page_id", T.normal_path(path).alias("path"))


@add("t20_tags", r"select conv_id, turn, trim(regexp_extract('<thinking>t</thinking><answer> ' || text || ' </answer>', '(?s)<answer>(.*?)</answer>', 1)) as answer, greatest(0.0, least(1.0, coalesce(try_cast(regexp_extract('STATUS: revise CONFIDENCE: ' || (turn + 5) / 10, '(?i)CONFIDENCE:\s*([0-9.]+)', 1) as double), 0.5))) as confidence from conversations")
def t20(spark, sf):
    said = F.concat(F.lit("<thinking>t</thinking><answer> "), "text", F.lit(" </answer>"))
    r = T.reflection(F.concat(F.lit("STATUS: revise CONFIDENCE: "), ((F.col("turn") + 5) / 10).cast("string")))
    return load(spark, sf, "conversations").select("conv_id", "turn", T.tagged(said, "answer").alias("answer"), r["confidence"].alias("confidence"))


@add(
    "t22_context_summary",
    r"""with s as (select item_id, unnest(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]?')) as s, unnest(range(len(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]?')))) as pos from benchmark),
    t as (select item_id, pos, trim(s) as s from s where length(trim(s)) >= 12), r as (select *, sum(length(s)) over (partition by item_id order by pos) as upto from t)
    select item_id, string_agg(s, ' ' order by pos) as summary from r where upto <= 120 group by item_id""",
)
def t22(spark, sf):
    """Whole sentences from the start, up to the first that would not fit."""
    from pyspark.sql import Window

    s = load(spark, sf, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    w = Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = s.withColumn("upto", F.sum(F.length("s")).over(w)).where("upto <= 120").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("l"))
    return kept.select("item_id", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("summary"))


@add("t10_t11_excerpts", r"""with d as (select doc_id, text, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2) as toks,
    list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]?'), lambda s: trim(s, ' ')), lambda s: length(s) >= 12) as own from documents),
  e as (select *, (list_filter(toks, lambda x, i: list_position(toks, x) = i))[1:3] as k, list_transform(own, lambda s: trim(regexp_replace(replace(s, '　', ' '), '\s+', ' ', 'g'), ' ')) as flat from d),
  f as (select *, list_filter(own, lambda s: len(list_filter(k, lambda w: contains(lower(s), w))) > 0) as hit from e)
  select doc_id, array_to_string((list_filter(flat, lambda x, i: list_position(flat, x) = i))[1:3], chr(10)) as key_sentences, array_to_string((case when len(hit) > 0 then hit else own end)[1:3], ' ') as excerpt from f""")
def t10(spark, sf):
    d = load(spark, sf, "documents").withColumn("k", T.first_keywords(F.col("text"), 3))
    return d.select("doc_id", F.array_join(T.key_sentences(F.col("text")), "\n").alias("key_sentences"), T.query_excerpt(F.col("text"), F.col("k")).alias("excerpt"))


@add("c04_c05_page_furniture", r"""
    with b as (select source, doc_id, text, row_number() over (partition by source order by doc_id) as page from documents),
    l as (select source, page, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos, len(string_split(text, chr(10))) as n from b),
    t as (select source, page, pos, n, trim(regexp_replace(line, '\s+', ' ', 'g')) as line from l),
    pages as (select source, count(*) as pages from b group by source),
    h as (select source, line, count(*) as c from t where pos < 2 and length(line) >= 4 group by all),
    f as (select source, line, count(*) as c from t where pos >= n - 2 and length(line) >= 4 group by all),
    m as (select t.*, h.c >= case when pages >= 3 then 2 else pages end as head, f.c >= case when pages >= 3 then 2 else pages end as foot
      from t join pages using (source) left join h on h.source = t.source and h.line = t.line left join f on f.source = t.source and f.line = t.line)
    select source, count(*) as n_lines, count_if(pos < 2 and coalesce(head, false)) as n_header, count_if(not (pos < 2 and coalesce(head, false)) and pos >= n - 2 and coalesce(foot, false)) as n_footer from m group by source""")
def c04(spark, sf):
    """Headers and footers that repeat over the pages of a source; a document is a page."""
    from corpusloom.operators.sections import furniture

    return furniture(load(spark, sf, "documents"))
