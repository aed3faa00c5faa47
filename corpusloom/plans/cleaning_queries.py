"""Queries over pages, headings, chunks and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import sections as S
from corpusloom.registry import REGISTRY
from corpusloom.session import load

add = REGISTRY.add
LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)"


def lines(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@add("c05_clean_pages", rf"""with l as (select source, doc_id as page, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos, len(string_split(text, chr(10))) as n from documents),
  t as (select source, page, pos, n, trim(regexp_replace(line, '\s+', ' ', 'g')) as line from l), pages as (select source, count(*) as pages from documents group by source),
  h as (select source, line, count(*) as c from t where pos < 2 and length(line) >= 4 group by all), f as (select source, line, count(*) as c from t where pos >= n - 2 and length(line) >= 4 group by all),
  m as (select t.*, pos < 2 and coalesce(h.c >= case when pages >= 3 then 2 else pages end, false) as head, pos >= n - 2 and coalesce(f.c >= case when pages >= 3 then 2 else pages end, false) as foot
    from t join pages using (source) left join h on h.source = t.source and h.line = t.line left join f on f.source = t.source and f.line = t.line),
  r as (select *, case when line = '' then 'blank' when head or foot then 'furniture' when regexp_matches(line, '{T.TOC}') or (contains(line, '目录') and length(line) <= 12) then 'toc' when regexp_matches(line, '{T.PAGE_NOISE}') then 'noise' else '' end as reason from m)
  select source as doc, page, md5(string_agg(line, chr(10) order by pos) filter (reason = '')) as text, count_if(reason = 'furniture') as n_furniture, count_if(reason = 'toc') as n_toc, count_if(reason = 'noise') as n_noise from r group by source, page having count_if(reason = '') > 0""")
def c05(spark, sf):
    """A document is a page of its source."""
    return S.clean_pages(load(spark, sf, "documents")).withColumn("text", F.md5("text"))


@add("c17_noise_chunks", r"select doc_id from documents where contains(text, 'Licensed under') or (len(regexp_extract_all(text, '\.\.\.')) >= 5 and len(regexp_extract_all(text, '\p{L}')) < length(text) * 0.3)")
def c17(spark, sf):
    return load(spark, sf, "documents").where(T.noise_chunk(F.col("text"), ["Licensed under"], "latin")).select("doc_id")


@add("k01_section_paths", f"""with recursive {LINES}, h as (select doc_id, pos, 1 + length(line) % 3 as level, trim(line, ' ') as title, row_number() over (partition by doc_id order by pos) as rn from l where length(line) between 1 and 60),
  r as (select doc_id, pos, rn, ['doc', title] as stack from h where rn = 1 union all select h.doc_id, h.pos, h.rn, list_concat(list_concat(r.stack[1:1], r.stack[2:h.level]), [h.title]) from r join h on h.doc_id = r.doc_id and h.rn = r.rn + 1)
  select doc_id, pos, array_to_string(stack, ' > ') as path from r""")
def k01(spark, sf):
    heads = lines(spark, sf).where(F.length("line").between(1, 60)).select("doc_id", "pos", (1 + F.length("line") % 3).alias("level"), F.trim("line").alias("title"), F.lit("doc").alias("root"))
    return S.section_paths(heads)


@add("k05_chunk_lines", rf"""with {LINES}, a as (select doc_id, pos, trim(replace(case when pos % 3 = 0 then (doc_id % 150) || line else line end, '　', ' '), ' ') as raw from l), b as (select *, regexp_extract(raw, '^(\d{{1,3}})\p{{L}}', 1) as num from a),
  c as (select doc_id, pos, case when num <> '' then num::int else 0 end as page, trim(regexp_replace(case when num <> '' then substr(raw, length(num) + 1) else raw end, '\s+', ' ', 'g'), ' ') as line from b)
  select doc_id, page, count(*) as n_lines, sum(length(line)) as n_chars from c where not (line = '' or regexp_matches(line, '^\d{{1,3}}$') or len(regexp_extract_all(line, '…')) >= 3 or length(line) - length(replace(line, '.', '')) >= 10 or (contains(line, '|') and len(regexp_extract_all(line, '\p{{L}}')) < 8)) group by all""")
def k05(spark, sf):
    numbered = lines(spark, sf).withColumn("line", F.when(F.col("pos") % 3 == 0, F.concat((F.col("doc_id") % 150).cast("string"), "line")).otherwise(F.col("line"))).withColumn("page", F.lit(0))
    return S.chunk_lines(numbered, "latin", []).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@add("k06_blocks", f"""with {LINES}, s as (select *, length(line) < 40 as h, sum((length(line) < 40)::int) over (partition by doc_id order by pos rows unbounded preceding) as section_no from l)
  select doc_id, cast(section_no as bigint) as section_no, sum(length(line)) filter (not h) as n_chars from s group by doc_id, section_no having count(*) filter (not h) > 0 and sum(length(line)) filter (not h) >= 90""")
def k06(spark, sf):
    return S.sections(lines(spark, sf), F.length("line") < 40, least=180).select("doc_id", "section_no", "n_chars")


@add("k08_merged_chunks", f"""with {LINES}, c as (select doc_id, pos, left(line, 1) || chr(1) || line as x from l where line <> ''), g as (select doc_id, list(x order by pos) as xs from c group by doc_id),
  f as (select doc_id, list_reduce(xs, lambda a, x: case when split_part(string_split(a, chr(2))[-1], chr(1), 1) = split_part(x, chr(1), 1) and length(split_part(string_split(a, chr(2))[-1], chr(1), 2)) < 180 then a || ' ' || split_part(x, chr(1), 2) else a || chr(2) || x end) as m from g)
  select doc_id, unnest(range(len(string_split(m, chr(2))))) as chunk_no, md5(split_part(unnest(string_split(m, chr(2))), chr(1), 2)) as digest from f""")
def k08(spark, sf):
    chunks = lines(spark, sf).where("line <> ''").select("doc_id", F.col("pos").alias("ord"), F.substring("line", 1, 1).alias("section"), F.col("line").alias("text"))
    return S.merge_small(chunks).select("doc_id", "chunk_no", F.md5("text").alias("digest"))


@add("t13_content_fingerprint", r"""with d as (select doc_id, regexp_extract_all(text, '\p{L}') as ls, regexp_extract_all(text, '[a-z]{2,4}') as ws from documents), u as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from d), g as (select doc_id, w, count(*) as n, min(i) as i from u group by all),
  r as (select *, row_number() over (partition by doc_id order by n desc, i) as rn from g), t as (select doc_id, string_agg(w, '' order by rn) as top from r where rn <= 3 group by doc_id) select d.doc_id, array_to_string(ls[1:200], '') || coalesce(top, '') as fingerprint from d left join t on t.doc_id = d.doc_id""")
def t13(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.content_fingerprint(F.col("text"), "latin", words="[a-z]{2,4}").alias("fingerprint"))


@add("t08_split_rows", r"""with p as (select p_partkey, p_name || ' code: ' || p_partkey || ' brand: ' || p_brand || '. size ' || p_size || ' type: ' || p_type as line from part), c as (select p_partkey, trim(regexp_replace(line, '\s+', ' ', 'g'), ' ') as line from p),
  s as (select p_partkey, line, list_filter(list_transform(string_split(regexp_replace(line, '(brand|code|size|type)(\s*[：:]|\s+)', chr(1) || '\1\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^[ ，、；：,.]+|[ ，、；：,.]+$', '', 'g')), lambda x: x <> '') as x from c),
  j as (select p_partkey, line, array_to_string(list_transform(x, lambda y: case when length(replace(y, ' ', '')) < 8 then ' ' || y else chr(1) || y end), '') as j from s),
  f as (select p_partkey, line, list_filter(string_split(regexp_replace(j, '^[^' || chr(1) || ']*', ''), chr(1)), lambda y: y <> '') as f from j) select p_partkey, array_to_string(case when length(line) < 28 or len(f) = 0 then [line] else f end, '|') as fragments from f""")
def t08b(spark, sf):
    line = F.concat_ws("", "p_name", F.lit(" code: "), "p_partkey", F.lit(" brand: "), "p_brand", F.lit(". size "), "p_size", F.lit(" type: "), "p_type")
    return load(spark, sf, "part").select("p_partkey", F.array_join(T.split_labelled(line, ["code", "brand", "size", "type"]), "|").alias("fragments"))
