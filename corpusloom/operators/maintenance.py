"""Incremental indexing, caches, sessions and telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.similar import cosine_join
from corpusloom.session import written


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, status): added, modified, deleted or unchanged by the content's SHA-256."""
    a, b = old.select("doc_id", F.sha2("text", 256).alias("was")), new.select("doc_id", F.sha2("text", 256).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") == F.col("is"), "unchanged").otherwise("modified")
    return a.join(b, "doc_id", "full").select("doc_id", status.alias("status"))


def update_index(chunks: DataFrame, found: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of unchanged documents, and the fresh chunks of added and modified ones."""
    gone = found.where("status in ('modified', 'deleted')").select("doc_id")
    come = found.where("status in ('modified', 'added')").select("doc_id")
    return chunks.join(gone, "doc_id", "left_anti").unionByName(fresh.join(come, "doc_id", "left_semi"))


def cache_hits(asked: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """I3, exact: (key, result) of entries that haven't expired; a ttl of 0 or less never does."""
    live = entries.where((F.col("ttl") <= 0) | (F.col("ts") + F.make_interval(secs=F.col("ttl")) > now))
    return asked.join(live, "key")


def evict(entries: DataFrame, capacity: int) -> DataFrame:
    """What stays: the most hit; of equally hit ones the newest. The aggregate of hit counts finds the cut, so
    only entries with as many hits as the cut are sorted."""
    w = Window.partitionBy("hit_count").orderBy(F.desc("ts"), "key")
    counts = entries.groupBy("hit_count").agg(F.count("*").alias("n"))
    over = Window.orderBy(F.desc("hit_count")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each hit count
    room = counts.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).select("hit_count", "before")
    placed = entries.join(room, "hit_count").where(F.col("before") < capacity).withColumn("place", F.col("before") + F.row_number().over(w))
    return placed.where(F.col("place") <= capacity)


def _match(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Inner join by equal columns, null equal to null."""
    renamed = b.withColumnsRenamed({k: f"{k}__r" for k in by})
    return a.join(renamed, reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"{k}__r")), by, F.lit(True))).drop(*(f"{k}__r" for k in by))


def percentile_stats(points: DataFrame, keys: list[str], value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000, most: int = 10_000) -> DataFrame:
    """Count, mean, least, most and percentiles by index floor(n p), clamped, without interpolation. Null values don't count.

    Ranks are found in rounds. A sketch of each key gives a bracket around each wanted rank, counts say how many values lie below
    and inside it, and only what is inside goes on, until a bracket holds one value or at most ``most`` rows. Sketches and counts are
    merged from partial ones, so no task sees a whole key, however hot; a round leaves about one row in ``accuracy`` / 4.
    """
    rows = points.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", [min(1.0, max(0.0, p + s / accuracy)) for p in ps for s in (-2, 2)], accuracy).alias("q"))
    stats = written(stats, "sketch")
    own, found = [*keys, "i"], []
    sizes = ("below", "at_lo", "inner", "at_hi")
    places = lambda lo, hi: (F.col("v") < lo, F.col("v") == lo, (F.col("v") > lo) & (F.col("v") < hi), (F.col("v") == hi) & (lo < hi))
    # the first round reads the table; its counts are taken beside each other, so a row stays one row
    j = _match(rows, stats.select(*keys, "q"), keys)
    lo, hi = (lambda i: F.get("q", F.lit(2 * i))), (lambda i: F.get("q", F.lit(2 * i + 1)))
    counts = j.groupBy(*keys).agg(*(F.count_if(c).alias(f"{name}{i}") for i in range(len(ps)) for name, c in zip(sizes, places(lo(i), hi(i)), strict=True)))
    per = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("rank"), lo(i).alias("lo"), hi(i).alias("hi"), *(F.col(f"{name}{i}").alias(name) for name in sizes)) for i, p in enumerate(ps))))
    state = _match(stats.select(*keys, "n", "q"), counts, keys).select(*keys, "n", per.alias("w")).select(*keys, "n", "w.*")
    rest = j.withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(len(ps)))))).where((F.col("v") > F.get("q", 2 * F.col("i"))) & (F.col("v") < F.get("q", 2 * F.col("i") + 1))).select(*own, "v")
    while True:
        after = F.col("rank") - F.col("below")
        x = F.when(after < F.col("at_lo"), F.col("lo")).when(after >= F.col("at_lo") + F.col("inner"), F.col("hi"))
        state = written(state.select(*own, x.alias("x"), (after - F.col("at_lo")).alias("rank"), F.col("inner").alias("n"), ((after < 0) | (after >= F.col("at_lo") + F.col("inner") + F.col("at_hi"))).alias("missed")), "ranks")
        if state.where("missed").limit(1).count():
            raise ValueError("a sketch missed its rank: raise the accuracy")
        found.append(state.where("x is not null").select(*own, "x"))
        going = state.where("x is null")
        rest = written(_match(rest, going.select(*own), own), "inside")
        if not going.where(F.col("n") > most).limit(1).count():
            break
        # brackets of about a twentieth of what is left, without the values that the last ones ended at
        sketch = rest.groupBy(*own).agg(F.percentile_approx("v", [k / 64 for k in range(65)], accuracy).alias("q"))
        at = F.floor(F.col("rank") / F.col("n") * 64).cast("int")
        named = _match(sketch, going.select(*own, "rank", "n"), own).select(*own, "rank", F.get("q", F.greatest(at - 1, F.lit(0))).alias("lo"), F.get("q", F.least(at + 2, F.lit(64))).alias("hi"))
        met = _match(rest, written(named, "brackets"), own)
        state = met.groupBy(*own, "lo", "hi", "rank").agg(*(F.count_if(c).alias(name) for name, c in zip(sizes, places(F.col("lo"), F.col("hi")), strict=True)))
        rest = met.where("v > lo and v < hi").select(*own, "v")
    few = rest.groupBy(*own).agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most ``most`` values each
    found.append(_match(few, going.select(*own, "rank"), own).select(*own, F.get("vs", F.col("rank").cast("int")).alias("x")))
    picked = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(*(F.round(F.max(F.when(F.col("i") == i, F.col("x"))), 6).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)))
    return _match(stats, picked, keys).select(*keys, "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")), *(f"p{round(p * 100)}" for p in ps))


def last_points(points: DataFrame, key: str, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last ``n`` points of each series."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return points.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def activity(events: DataFrame, until: Column, hours: int) -> DataFrame:
    """Numbers of a time range by type: events, mean and slow ones."""
    inside = events.where(F.col("ts") > until - F.make_interval(hours=F.lit(hours)))
    return inside.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 100).alias("slow"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count and share of each value, in per cent."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return g.crossJoin(total).select(key, "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """A text line for each (name, label, value)."""
    return metrics.select(F.format_string('%s{type="%s"} %d', "name", "label", "value").alias("line"))


def latest(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last value written for each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def sessions(messages: DataFrame) -> DataFrame:
    """A row for each session: messages, roles and the first title."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.countDistinct("role").alias("roles"), F.max("turn").alias("last_turn"), F.min_by(F.substring("text", 1, 20), "turn").alias("title"))


def day_bucket(ts: Column, today: Column) -> Column:
    """V5: today, yesterday, last 7 days or earlier."""
    days = F.datediff(today, ts)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "last 7 days").otherwise("earlier")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the same key replaced."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def slow(kind: Column, seconds: Column) -> Column:
    """Whether a query, retrieval or generation took longer than 3, 1.5 or 2 seconds."""
    return F.when(kind == "query", seconds > 3.0).when(kind == "retrieval", seconds > 1.5).when(kind == "generation", seconds > 2.0).otherwise(False)


def running_counters(points: DataFrame, key: str, order: str, block: int = 10_000) -> DataFrame:
    """``counter``, the running sum of ``delta`` in the order of ``order`` (whole numbers) for each key.

    Sums are taken in blocks of the order, so a hot key is sorted in many tasks; a key's blocks have a row each.
    """
    cut = points.withColumn("block", F.floor(F.col(order) / block))
    own = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(key, "block").agg(F.sum("delta").alias("total"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return cut.join(offsets, [key, "block"]).withColumn("counter", F.col("offset") + F.sum("delta").over(own)).drop("block", "offset")


def cached(asked: DataFrame, entries: DataFrame, now: Column, least: float = 0.88) -> DataFrame:
    """(query_id, key, kind, similarity): the entry that answers each query (query_id, key, vector): the one with its
    key, else the live one with the most similar vector, from ``least`` > 0 on; of equally similar ones the least key.

    Entries are (key, vector, ts, ttl); a ttl of 0 or less never ends. Vectors meet in blocks of cells around pivots, each
    of which passes on the best of each query.
    """
    live = entries.where((F.col("ttl") <= 0) | (F.col("ts") + F.make_interval(secs=F.col("ttl")) > now))
    exact = asked.join(live.select("key"), "key", "left_semi").select("query_id", "key", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    rest = asked.join(exact.select("query_id"), "query_id", "left_anti")
    best = cosine_join(rest.select(F.col("query_id").alias("id"), "vector"), live.select(F.col("key").alias("id"), "vector"), least, nearest=True)
    return exact.unionByName(best.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("key"), F.lit("similar").alias("kind"), "similarity"))


def insert(entries: DataFrame, rows: DataFrame, capacity: int) -> DataFrame:
    """Rows of the same key replaced, and what then is over ``capacity`` goes by I4."""
    return evict(upsert(entries, rows, "key"), capacity).drop("before", "place")


def cache_statistics(entries: DataFrame, capacity: int) -> DataFrame:
    """Entries, share of the capacity, hits, mean and most hits."""
    return entries.agg(
        F.count("*").alias("total_entries"), F.round(F.count("*") / F.lit(capacity), 6).alias("usage_ratio"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        F.round(F.coalesce(F.avg("hit_count"), F.lit(0.0)), 6).alias("avg_hits"), F.coalesce(F.max("hit_count"), F.lit(0)).alias("max_hits"),
    )


def append_message(sessions_: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions (session_id, updated_at, messages) with the rows (session_id, at, message) put to their end, in the order
    of time, and updated_at moved on. Messages of unknown sessions are left out."""
    new = messages.groupBy("session_id").agg(F.max("at").alias("last"), F.transform(F.sort_array(F.collect_list(F.struct("at", "message"))), lambda x: x["message"]).alias("more"))
    j = sessions_.join(new, "session_id", "left")
    return j.select("session_id", F.greatest("updated_at", "last").alias("updated_at"), F.when(F.col("more").isNull(), F.col("messages")).otherwise(F.concat("messages", "more")).alias("messages"))


def revoke(tokens: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """The tokens with those that ``which`` names revoked, and the number of rows that changed."""
    hit = which & ~F.col("is_revoked")
    return tokens.withColumn("is_revoked", F.col("is_revoked") | which), tokens.agg(F.count_if(hit).alias("changed"))


def listing(rows: DataFrame, user: Column | None, order: str, key: str) -> DataFrame:
    """Rows of one user, or all, the newest first."""
    return (rows if user is None else rows.where(user)).orderBy(F.desc(order), key)


def candidate_key(query: Column, k: int, vector: bool | None, keyword: bool | None) -> Column:
    """The cache key of a search as JSON with sorted names."""
    lit = lambda b: F.lit(b).cast("boolean")
    return F.to_json(F.struct(query.alias("query"), F.lit(k).alias("top_k"), lit(keyword).alias("use_keyword"), lit(vector).alias("use_vector")), {"ignoreNullFields": "false"})


def enriched(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows with what a small dimension says of their key; Spark broadcasts the dimension if it is small."""
    return rows.join(facts, key, "left")


def statistics(events: DataFrame, until: Column, ranges: dict[str, int | None]) -> DataFrame:
    """Numbers of each time range (hours; None: all) by type in one pass: events, mean and slow ones."""
    inside = F.filter(F.array(*(F.when(F.lit(h is None) | (F.col("ts") > until - F.make_interval(hours=F.lit(h or 0))), F.lit(name)) for name, h in ranges.items())), lambda x: x.isNotNull())
    return events.withColumn("range", F.explode(inside)).groupBy("range", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 100).alias("slow"))


def broken_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that a unique index over ``keys`` would refuse, with how often they occur."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def live_sessions(sessions_: DataFrame, now: Column, ttl: int = 86_400) -> DataFrame:
    """The sessions that a store with a time to live still has: those updated less than ``ttl`` seconds ago."""
    return sessions_.where(F.col("updated_at") + F.make_interval(secs=F.lit(ttl)) > now)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows of these keys; ``table.join(keys, key)`` gets them, an empty one resets."""
    return table.join(keys.select(key), key, "left_anti")


def snapshot(points: DataFrame) -> DataFrame:
    """What each metric (name, ts, value, kind) has recorded: number, sum, mean, least, most, the last value and how many
    are slow for their kind."""
    return points.groupBy("name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.max_by("value", F.struct("ts", "value")).alias("last"), F.count_if(slow(F.col("kind"), F.col("value"))).alias("slow"),
    )
