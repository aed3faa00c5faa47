"""URL filter: host and path rules, and for the rest two character language models.

The models are Markov chains of variable order over host and path, one for URLs that the rules allow and one for those
that they block. The probability of a character is Witten-Bell smoothed from no context up to ORDER characters. A URL's
score is the difference of its log-likelihoods divided by its number of characters (with its end). The cut is calibrated
on a fifth of the hosts, scored by models of the other four fifths; the models that judge are those of all URLs with a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, stored

#: Characters of a context, and of a piece of a line.
ORDER, PIECE = 4, 256
#: A character that no model has seen is one of so many.
ALPHABET = 256.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Start and end of a URL, which no URL holds unescaped.
START, END = "\x02", "\x03"
#: So many n-grams at most are broadcast, of at most ORDER + 1 characters each: a few MB.
FEW = 50_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains where the path starts so."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(str(r))).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def grams(lines: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``line`` and its end: the context of at most ORDER characters, and the character.

    A line is cut to pieces first, each with the last characters of the one before, so a row never carries a whole long line.
    """
    whole = F.concat(F.lit(START), "line", F.lit(END))
    cut = lines.select(*keep, F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("parts"))
    before = F.transform("parts", lambda x, j: F.when(j > 0, F.right(F.get("parts", j - 1), F.lit(ORDER))).otherwise(""))
    piece = cut.select(*keep, F.posexplode(F.arrays_zip(before.alias("before"), F.col("parts").alias("part"))).alias("j", "p"))
    piece = piece.select(*keep, F.concat("p.before", "p.part").alias("w"), F.when(F.col("j") > 0, F.length("p.before") + 1).otherwise(2).alias("first"))
    at = piece.where(F.length("w") >= F.col("first")).select(*keep, "w", F.explode(F.sequence("first", F.length("w"))).alias("i"))
    start = F.greatest(F.lit(1), F.col("i") - ORDER)
    return at.select(*keep, F.substring("w", start, F.col("i") - start).alias("ctx"), F.substring("w", F.col("i"), F.lit(1)).alias("c"))


def orders(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row once for every shorter context but the empty one, the longest first at k = length."""
    n = F.length("ctx")
    return rows.where("ctx <> ''").select(*keep, "ctx", "c", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("sub", F.expr("right(ctx, k)"))


def log_ratios(train: DataFrame, asked: DataFrame) -> DataFrame:
    """(ctx, c, llr): the log ratio of the two smoothed probabilities for each distinct (ctx, c) of ``asked``.

    ``train`` has (ctx, c, a, b): the weights with which the n-gram occurs in either class.
    """
    train = stored(train, "train")
    counted = stored(orders(train, "a", "b").groupBy("sub", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")
    kinds = [F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}") for x in "ab"]
    of_context = counted.groupBy("sub").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), *kinds)
    parts = orders(asked).join(of_context, "sub", "left").join(counted.select("sub", "c", "a", "b"), ["sub", "c"], "left")
    names = ("a", "na", "ta", "b", "nb", "tb")
    level = F.struct("k", *(F.coalesce(x, F.lit(0.0)).cast("double").alias(x) for x in names))

    def smoothed(n: str, total: str, kinds: str) -> Column:
        def step(p: Column, x: Column) -> Column:
            return F.when(x[total] > 0, (x[n] + x[kinds] * p) / (x[total] + x[kinds])).otherwise(p)

        return F.aggregate("levels", F.lit(1.0 / ALPHABET), step)

    # every n-gram has the empty context, so its counts are no join's key: a row for each character there is
    letters = stored(train.groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "letters")
    whole = letters.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), *kinds).first()
    zero = F.struct(F.lit(0).alias("k"), *(F.coalesce(F.col(x) if x in "ab" else F.lit(whole[x]), F.lit(0.0)).cast("double").alias(x) for x in names))
    folded = parts.groupBy("ctx", "c").agg(F.sort_array(F.collect_list(level)).alias("longer"))  # ORDER at most
    both = asked.select("ctx", "c").join(folded, ["ctx", "c"], "left").join(F.broadcast(letters), "c", "left")
    both = both.withColumn("levels", F.concat(F.array(zero), F.coalesce("longer", F.array().cast(folded.schema["longer"].dataType))))
    out = stored(both.select("ctx", "c", (F.log(smoothed("a", "na", "ta")) - F.log(smoothed("b", "nb", "tb"))).alias("llr")), "ratios")
    discard(train, counted, letters)
    return out


def scores(lines: DataFrame, train: DataFrame) -> DataFrame:
    """``lines`` (id, host, path, ruled, n, line) with the score that models of the URLs in ``train`` give them. Only ids go along with
    the n-grams."""
    weight = [F.when(F.col("ruled") == v, F.col("n")).otherwise(0.0).alias(x) for v, x in (("allow", "a"), ("block", "b"))]
    counts = grams(train.select("line", *weight), "a", "b").groupBy("ctx", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    places = grams(lines, "id")
    table = log_ratios(counts, places.select("ctx", "c").distinct())
    few = table.count() <= FEW
    each = places.join(F.broadcast(table) if few else table.hint("merge"), ["ctx", "c"])
    sums = each.groupBy("id").agg(F.round(F.sum("llr") / F.count("*"), 6).alias("score"))
    out = stored(lines.select("id", "host", "path", "ruled", "n").join(sums, "id").drop("id"), "scores")
    discard(table)
    return out


def calibrate(scored: DataFrame) -> float:
    """The cut between hundredths of ``score`` that parts allowed from blocked URLs best (the sum of both shares).

    ``scored`` has (score, n, verdict); without both verdicts the cut is 0.
    """
    bins = scored.groupBy(F.floor(F.least(F.greatest(F.col("score"), F.lit(-50.0)), F.lit(50.0)) * 100).alias("bin")).pivot("verdict", ["allow", "block"]).agg(F.sum("n"))
    rows = sorted((r["bin"], r["allow"] or 0, r["block"] or 0) for r in bins.collect())  # 10,001 bins at most
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return 0.0
    best, cut, below_a, below_b = -1.0, 0.0, 0, 0
    for at, a, b in rows:
        gain = (allow - below_a) / allow + below_b / block
        if gain > best:
            best, cut = gain, at / 100
        below_a, below_b = below_a + a, below_b + b
    return cut


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    verdict is the longest fitting rule's; where none fits, allow if the URL's score reaches the cut, else block. score is
    null where a rule decides. A null URL or one without ``://`` has an empty host and path and is scored as such. If the
    rules leave one class without URLs, scores are still defined and the cut is 0, as it is if the held fifth has one class. Repeated rows give a row each.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    lines = base.groupBy("host", "path", "ruled").agg(F.count("*").cast("double").alias("n")).withColumn("line", F.concat("host", "path"))
    lines = stored(lines.withColumn("held", F.pmod(F.xxhash64("host"), F.lit(5)) == 0).withColumn("id", F.monotonically_increasing_id()), "urls")
    ruled = lines.where("ruled is not null")
    cut = calibrate(scores(ruled.where("held"), ruled.where("not held")).select("score", "n", F.col("ruled").alias("verdict")))
    scored = scores(lines.where("ruled is null"), ruled)
    open_ = scored.where("ruled is null").select("host", "path", "score", F.lit(True).alias("open"))
    found = base.withColumn("open", F.when(F.col("ruled").isNull(), F.lit(True))).join(open_.hint("merge"), ["host", "path", "open"], "left")
    by_model = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return found.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
