"""Column functions for cleaning, predicates and extraction. All stay in the JVM; patterns are the subset that Java and
RE2 read alike, with Unicode ranges written out where the reference means CJK. ``SCRIPT`` names the letters that count as
content: ``cjk``, or ``latin`` (any letter) for text in alphabets."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = {"cjk": r"[\x{4e00}-\x{9fff}]", "latin": r"\p{L}"}
# Patterns and word lists of the cleaning rules.
PAGE_NOISE = r"^(第\s*\d+\s*页|\d+\s*/\s*\d+|(?i:目录|contents))$"
TOC = r"[.．…]{4,}\s*\d+$"
HEADING_ONLY = r"^(第[一二三四五六七八九十百零\d]+[章节篇条款]\s*[^。；;!?！？]{0,40}|[一二三四五六七八九十]+、[^。；;!?！？]{0,40})$"
OCR_NOISE = r"[\x{fffd}□◻]|[A-Za-z]{8,}\d{3,}"
NOISE_DIGITS = r"^[\d\s.,\-—_，、:：/]+$"
NOISE_DOTS = r"^[.\s…⋯·•]+$"
NOISE_FRAGMENT = r"^\d+[.、，]\s*[^\x{4e00}-\x{9fff}]{0,40}$"
NOISE_LATIN_START = r"^[a-zA-Z0-9][^\x{4e00}-\x{9fff}]{0,50}$"
TABLE_BORDER = r"^[|:：\-_=+/\\\s]+$"
CHECK_MARK = r"[√✓✔☑□■◆●○]"
CODE = r"\bpublic\s+class\b|\bSystem\.out\.println\b|\bimport\s+java\.|https?://|\b[A-Za-z_][A-Za-z0-9_]*\s*\(|[{};<>]{3,}"
TABLE_HINTS = ["课程体系与毕业要求", "关联度矩阵", "支撑关系", "指标点", "矩阵", "对应关系"]
FRAGMENT_PREFIX = r"^\s*(\d+[.、，]\s*|[一二三四五六七八九十]+、\s*)"
SECTION_TITLE = r"(第[一二三四五六七八九十百零\d]+[章节条款]|[一二三四五六七八九十]+、[^。\n]{1,20})"
PAGE_REFERENCE = r"(?i)(第?\s*\d+\s*页|p\.\s*\d+)"
NOISE_CHUNKS = ["校徽释义", "校训释义", "校风释义", "教风释义", "学风释义", "编制说明"]
SECRETS = ["password", "token", "secret", "api_key"]
HEADINGS = [(r"^第[一二三四五六七八九十百零\d]+[章节条款]", 1), (r"^[一二三四五六七八九十]+、", 2), (r"^\d+(\.\d+){0,3}[、.]?\s*", 2), (r"^[（(][一二三四五六七八九十\d]+[）)]", 3)]
TERMINATORS = ["。", "！", "？", ".", ";", "；"]


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def occurrences(c: Column, text: str) -> Column:
    """How often a literal occurs."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("int")


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def collapse(c: Column) -> Column:
    """Ideographic spaces are spaces, runs of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, "　", " "), r"\s+", " "))


def corpus_line(c: Column) -> Column:
    """C1 without bars and bullets, split headings put together."""
    out = F.trim(F.regexp_replace(collapse(F.translate(c, "•", " ")), r"^[| ]+|[| ]+$", ""))
    return F.regexp_replace(out, r"第\s+([一二三四五六七八九十百零\d]+)\s+([章节条款])", "第$1$2")


def scrub(c: Column) -> Column:
    """Form feeds part paragraphs, other control characters go, at most one blank line."""
    out = F.regexp_replace(F.replace(c, F.lit("\f"), F.lit("\n\n")), r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x{9f}]", "")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def page_noise(c: Column) -> Column:
    """C6."""
    return c.rlike(PAGE_NOISE)


def toc_line(c: Column, short: int = 12) -> Column:
    """A line of a table of contents."""
    return c.rlike(TOC) | (c.contains("目录") & (F.length(c) <= short))


def corpus_noise(c: Column) -> Column:
    """C7."""
    return c.rlike(r"^\s*$|^\d+$|^[·•.．…\-_]{4,}$|^[\d\s\-_/]+$") | (F.length(c) <= 2) | (occurrences(c, "…") >= 3) | (occurrences(c, ".") >= 8) | c.startswith("第 ")


def table_like(c: Column, script: str = "cjk") -> Column:
    """C8."""
    numbers = count(c, r"\b\d+(\.\d+)?\b")
    return contains_any(c, TABLE_HINTS) | ((numbers >= 8) & (count(c, SCRIPT[script]) < 20)) | (occurrences(c, "|") >= 3) | c.rlike(r"[1-9]\s+[1-9]\s+[1-9]")


def code_like(c: Column, script: str = "cjk") -> Column:
    """C9."""
    return c.rlike(CODE) | c.rlike("^(package |class |public |private |protected )") | ((occurrences(c, "=") >= 2) & (count(c, SCRIPT[script]) < 10))


def low_signal(c: Column, script: str = "cjk", outline: bool = False) -> Column:
    """C11: by shares of script, ASCII letters and digits; in outlines code counts as well."""
    total = F.greatest(F.length(c), F.lit(1))
    own, latin, digits = count(c, SCRIPT[script]), count(c, "[A-Za-z]"), count(c, r"\d")
    out = (own < 40) | (latin > own * 1.2) | ((own / total < 0.12) & (latin / total > 0.18)) | ((digits / total > 0.35) & (own / total < 0.2))
    return out | c.rlike(CODE) if outline else out


def matrix_row(c: Column, script: str = "cjk") -> Column:
    """C14."""
    own, checks = count(c, SCRIPT[script]), count(c, CHECK_MARK)
    columns = occurrences(c, "|") + count(c, r"\s{2,}")
    return (F.length(c) > 0) & (
        contains_any(c, TABLE_HINTS) | (checks >= 2) | ((checks >= 1) & (columns >= 2)) | (c.contains("|") & (own < F.length(c) * 0.45)) | ((columns >= 3) & (own < 14))
    )


def noise_line(c: Column, script: str = "cjk") -> Column:
    """C13."""
    return (
        c.rlike(NOISE_DIGITS) | c.rlike(NOISE_DOTS) | c.rlike(TABLE_BORDER) | c.rlike(NOISE_FRAGMENT)
        | (c.endswith("." * 22) & (F.length(c) < 100)) | (c.rlike(NOISE_LATIN_START) & (count(c, SCRIPT[script]) < 5) & (F.length(c) < 50))
    )


def fragment(c: Column) -> Column:
    """A piece too small or too foreign to stand alone."""
    return (F.length(c) == 0) | ((F.length(c) < 10) & (count(c, SCRIPT["cjk"]) < 4)) | c.rlike(NOISE_FRAGMENT) | c.rlike(NOISE_LATIN_START)


def without_prefix(c: Column) -> Column:
    """Without a leading number."""
    return F.regexp_replace(c, FRAGMENT_PREFIX, "")


def distinct_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))


def deep_clean(c: Column) -> Column:
    """Lines normalised, noise and matrix rows dropped, the first of equal lines kept, repeated marks squeezed."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(F.translate(x, "　", " "), r"[\t ]{2,}", " ")))
    kept = F.array_distinct(F.filter(lines, lambda x: (F.length(x) > 0) & ~noise_line(x) & ~matrix_row(x)))
    joined = F.array_join(kept, "\n")
    for mark in "，。！？；、":
        joined = F.regexp_replace(joined, f"{mark}+", mark)
    return joined


def valid_content(c: Column, script: str = "cjk") -> Column:
    """C16."""
    return (F.length(c) >= 20) & (count(c, SCRIPT[script]) >= 8) & (distinct_chars(c) >= F.greatest(F.length(c) * 0.2, F.lit(6.0)))


def valid_strict(c: Column, script: str = "cjk") -> Column:
    """C16, strict."""
    return F.length(c).between(80, 3000) & (count(c, SCRIPT[script]) >= 20) & (distinct_chars(c) >= F.length(c) * 0.25)


def low_quality(text: Column, section: Column, status: Column | None = None, score: Column | None = None, boilerplate: str | None = None, least: int = 12) -> Column:
    """C18; ``boilerplate`` is given in one of its two variants. A score of 0 is 0."""
    marks = F.length(text) - F.length(F.translate(text, "，。；：,.?!！？、/ ", ""))
    out = (F.length(text) < least) | ((section != "") & (text == section)) | ((marks / F.greatest(F.length(text), F.lit(1)) > 0.55) & (distinct_chars(text) < 18))
    if status is not None:
        out = out | F.coalesce(status == "reject", F.lit(False))
    if score is not None:
        out = out | F.coalesce(score < 0.30, F.lit(False))
    return out | text.rlike(boilerplate) if boilerplate else out


def mask_secrets(c: Column) -> Column:
    """C19."""
    for word in SECRETS:
        c = F.regexp_replace(c, rf"(?i){word}[\"']?\s*[:=]\s*[\"']?[^\"'\s,}}]+", f"{word}: ***")
    return c


def to_last_sentence(c: Column, ends: str = "。！？…") -> Column:
    """C20: up to the last terminator; unchanged without one."""
    found = F.regexp_extract(c, f"(?s)^(.*[{ends}])", 1)
    return F.when(found == "", c).otherwise(found)


def tokens(c: Column, mode: str = "word") -> Column:
    """Tokens in order, repeats included. ``cjk_bigram`` takes pairs of CJK characters instead of words."""
    if mode == "cjk_bigram":
        chars = F.regexp_extract_all(c, F.lit(SCRIPT["cjk"]), F.lit(0))
        return F.when(F.size(chars) < 2, chars).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), lambda i: F.concat(F.element_at(chars, i.cast("int")), F.element_at(chars, (i + 1).cast("int")))))
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def first_keywords(c: Column, limit: int = 8) -> Column:
    """The first distinct tokens of two characters or more."""
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= 2)), 1, limit)


def top_keywords(c: Column, limit: int = 8, stop: list[str] | None = None) -> Column:
    """The most frequent tokens of two characters or more; of equally frequent ones the first seen."""
    return frequent(F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(stop or [""])), limit)


def half_width(c: Column) -> Column:
    """Full-width marks to half-width, quotes dropped, spaces collapsed."""
    return collapse(F.translate(c, "（）：；！？，．【】“”‘’\"'", "():;!?,.[]"))


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences with their terminators, those shorter than ``least`` dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^。！？；.!?;\n]+[。！？；.!?;]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def labelled(c: Column, labels: list[str]) -> Column:
    """A line of at least 28 characters with two labels or more."""
    line = collapse(c)
    hits = sum((line.contains(x)).cast("int") for x in labels)
    return (F.length(line) >= 28) & (hits >= 2)


def fragments(c: Column, labels: list[str], least: int = 12) -> Column:
    """Sentences with their terminators, those that are labelled rows split before their labels; what is shorter than ``least``
    is dropped. White space is collapsed."""
    parts = F.flatten(F.transform(sentences(c, 1), lambda s: split_labelled(s, labels)))
    return F.filter(parts, lambda x: F.length(x) >= least)


def truncate_at_boundary(c: Column, limit: int, marks: list[str] | None = None, least: float = 0.55) -> Column:
    """Cut to ``limit`` characters after the last of the first mark that lies beyond ``least`` of it."""
    head = F.substring(c, 1, limit)
    choices = []
    for m in marks or ["。", ".", "；", ";", "，", ",", " "]:
        at = F.length(head) - F.locate(m, F.reverse(head)) + 1
        choices.append(F.when((F.locate(m, F.reverse(head)) > 0) & (at >= limit * least), F.substring(head, F.lit(1), at)))
    return F.when(F.length(c) <= limit, c).otherwise(F.rtrim(F.coalesce(*choices, head)))


def key_sentences(c: Column, n: int = 3) -> Column:
    """The first distinct sentences, white space collapsed."""
    return F.slice(F.array_distinct(F.transform(sentences(c), collapse)), 1, n)


def query_excerpt(c: Column, keywords: Column, n: int = 3) -> Column:
    """The first sentences that hold a keyword; without any, the first sentences."""
    own = sentences(c)
    hit = F.filter(own, lambda s: F.exists(keywords, lambda k: F.contains(F.lower(s), F.lower(k))))
    return F.array_join(F.slice(F.when(F.size(hit) > 0, hit).otherwise(own), 1, n), " ")


def section_title(c: Column) -> Column:
    """T12."""
    return F.regexp_extract(c, SECTION_TITLE, 1)


def page_reference(c: Column) -> Column:
    """T12."""
    return F.regexp_extract(c, PAGE_REFERENCE, 1)


def script_fingerprint(c: Column, script: str = "cjk", length: int = 80) -> Column:
    """The first characters of the script."""
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(SCRIPT[script]), F.lit(0)), 1, length), "")


def slug(c: Column) -> Column:
    """T15."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9\x{4e00}-\x{9fff}]+", "-"), "^-+|-+$", ""))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def course_mentions(c: Column) -> Column:
    """Codes of letters and digits, and names in quotation marks."""
    return F.concat(F.regexp_extract_all(c, F.lit("[A-Z]{2,4}[0-9]{3}"), F.lit(0)), F.regexp_extract_all(c, F.lit("《([^》]+)》"), F.lit(1)))


def concept_id(c: Column) -> Column:
    """T18."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def normal_path(c: Column) -> Column:
    """Parts that look like ids become {id}."""
    parts = F.split(F.regexp_replace(c, "^/+|/+$", ""), "/")
    named = F.transform(parts, lambda p: F.when((F.length(p) > 20) | ((F.length(p) > 8) & p.contains("-")), F.lit("{id}")).otherwise(p))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def tagged(c: Column, tag: str) -> Column:
    """What stands between a tag and its end."""
    return F.trim(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def reflection(c: Column) -> Column:
    """Status, confidence from 0 to 1 (0.5 where it is missing) and issues of a reflection."""
    value = F.regexp_extract(c, r"(?i)CONFIDENCE:\s*([0-9.]+)", 1)
    return F.struct(
        F.coalesce(F.nullif(F.upper(F.regexp_extract(c, r"(?i)STATUS:\s*(\w+)", 1)), F.lit("")), F.lit("PASS")).alias("status"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.5)))).alias("confidence"),
        F.trim(F.regexp_extract(c, r"(?i)ISSUES:\s*([^\n]*)", 1)).alias("issues"),
    )


def heading_level(c: Column) -> Column:
    """K1: the level of a heading line, null for others."""
    out = F.lit(None).cast("int")
    for pattern, level in reversed(HEADINGS):
        out = F.when(c.rlike(pattern), F.lit(level)).otherwise(out)
    return out


def noise_chunk(c: Column, words: list[str] | None = None, script: str = "cjk") -> Column:
    """C17: a chunk that holds one of the words, or one with five ellipses or more and few letters of the script."""
    return contains_any(c, NOISE_CHUNKS if words is None else words) | ((occurrences(c, "...") >= 5) & (count(c, SCRIPT[script]) < F.length(c) * 0.3))


def content_fingerprint(c: Column, script: str = "cjk", length: int = 200, words: str = r"[\x{4e00}-\x{9fff}]{2,4}") -> Column:
    """The first characters of the script, then the three most frequent words, of equally frequent ones the first seen."""
    own = F.regexp_extract_all(c, F.lit(words), F.lit(0))
    return F.concat(script_fingerprint(c, script, length), F.array_join(frequent(own, 3), ""))


def frequent(values: Column, n: int) -> Column:
    """The ``n`` most frequent values of a list, of equally frequent ones the first seen.

    Array functions in SQL would count each value against the whole list; a count over Arrow batches is linear.
    """

    @F.pandas_udf("array<string>")
    def counted(column: pd.Series) -> pd.Series:
        return column.map(lambda x: [v for v, _ in Counter(x if x is not None else ()).most_common(n)])

    return counted(values)


def split_labelled(c: Column, labels: list[str], least: int = 8) -> Column:
    """A line with two labels or more cut before each label that a colon or a space follows; pieces of fewer than ``least``
    characters without spaces go to the piece on their left, or away if they are the first. Other lines stay whole."""
    line = collapse(c)
    any_label = "|".join(sorted(labels, key=len, reverse=True))
    parts = F.split(F.regexp_replace(line, rf"({any_label})(\s*[：:]|\s+)", "\x01$1$2"), "\x01")
    clean = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ ，、；：,.]+|[ ，、；：,.]+$", "")), lambda x: x != "")
    short = lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))) < least
    # a mark before every piece that stands alone, then one cut; what comes before the first mark has nothing on its left
    joined = F.array_join(F.transform(clean, lambda x: F.when(short(x), F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit("\x01"), x))), "")
    fragments = F.filter(F.split(F.regexp_replace(joined, "^[^\x01]*", ""), "\x01"), lambda x: x != "")
    return F.when(~labelled(c, labels) | (F.size(fragments) == 0), F.array(line)).otherwise(fragments)
