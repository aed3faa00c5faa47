"""Numeric band join: rectangles over the matrix of two histograms, joined in place by binary search.

Both sides are counted in buckets that follow from the value alone, so either histogram has at most ``BUCKETS`` rows at
any size of the input. The matrix of the two holds few cells that the band can touch. Rows of the matrix are gathered to
strips, a strip's span of columns is cut to rectangles of about as many rows each, and a cell that is too full by itself,
such as one price that a third of all rows have, is cut by random numbers. A rectangle is a partition: it sorts its lines
once, finds the range of each item by binary search, and takes numbers, sums and checksums from running sums, so no pair
is ever written. What an item has found in several rectangles is added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import tidy

#: Cents up to PLAIN have a bucket each, beyond it buckets are a part of 1/FINE wide.
PLAIN, FINE = 200, 200
#: Values beyond this are not exact as doubles; they never pair. So there are at most BUCKETS buckets.
EXACT = 1 << 53
BUCKETS = 2 * (PLAIN + int(FINE * np.log(EXACT / PLAIN)) + 2)
#: Rows in a rectangle: at most, and at least where the input is small.
MOST, LEAST = 500_000, 20_000
#: Partial results of an item that meet in one group at most.
FAN = 64
NONE = -(1 << 63)


def cents(x: Column) -> Column:
    """floor(100 x + 0.5) in doubles; null for what is null, not finite or beyond exact doubles."""
    scaled = F.floor(x.cast("double") * 100 + 0.5)
    return F.when(F.abs(x.cast("double")) < EXACT / 200, scaled)


def unit_cents(amount: Column, quantity: Column) -> Column:
    """floor((2 a + q) / (2 q)) in integers, for cents a; null for no quantity."""
    q = quantity.cast("bigint")
    y = F.nullif(F.abs(q) * 2, F.lit(0).cast("bigint"))
    x = (cents(amount) * 2 + q) * F.when(q < 0, -1).otherwise(1)
    return F.call_function("div", x - F.pmod(x, y), y)


def bucket(v: Column) -> Column:
    """The bucket of an integer: grows with it, and takes BUCKETS values at most."""
    size = F.abs(v)
    beyond = F.floor(F.log(size / F.lit(float(PLAIN))) * FINE).cast("int") + PLAIN
    return F.signum(v).cast("int") * F.when(size <= PLAIN, size.cast("int")).otherwise(beyond)


@dataclass(frozen=True)
class Band:
    """An item at p meets values of [low(p), high(p)]: a gap of ``flat`` at most, or ``parts`` * gap <= ``share`` * min(p, value)."""

    flat: int = 50
    share: int = 5
    parts: int = 1000

    def low(self, p):
        """Also for arrays. Below p the smaller is the value: parts (p - u) <= share u."""
        return np.minimum(p - self.flat, -(-(p * self.parts) // (self.parts + self.share)))

    def high(self, p):
        return np.maximum(p + self.flat, p + (p * self.share) // self.parts)


@dataclass
class Strip:
    """Rows of the matrix with their rectangles: (first and last column, cuts of the items, cuts of the lines, first region)."""

    rows: tuple[int, int]
    rectangles: list[tuple[int, int, int, int, int]]


def tile(items: list[tuple[int, int, int, int]], lines: list[tuple[int, int, int, int]], band: Band, most: int) -> tuple[list[Strip], int]:
    """Strips over two histograms of (bucket, least, greatest, rows), in order, and the number of regions.

    Every cell that the band can touch is in one rectangle. A strip grows while it has a fourth of ``most`` items and its span
    of lines fits a rectangle or is at most twice the first row's, so that lines are in about two strips.
    """
    least, greatest = np.array([x[1] for x in lines], np.int64), np.array([x[2] for x in lines], np.int64)
    n_lines = np.array([x[3] for x in lines], np.int64)
    upto = np.concatenate([[0], np.cumsum(n_lines)])
    low = np.array([int(band.low(x[1])) for x in items], np.int64)
    high = np.array([int(band.high(x[2])) for x in items], np.int64)
    c0, c1 = np.searchsorted(greatest, low, "left"), np.searchsorted(least, high, "right")  # columns [c0, c1)
    strips, regions, i = [], 0, 0
    while i < len(items):
        first, count, j = upto[c1[i]] - upto[c0[i]], items[i][3], i + 1
        while j < len(items):
            span = upto[max(c1[i:j + 1])] - upto[c0[i]]
            if count + items[j][3] > most // 4 or span > max(2 * first, most * 3 // 4):
                break
            count, j = count + items[j][3], j + 1
        a, b = int(c0[i]), int(max(c1[i:j]))
        if upto[b] > upto[a]:
            cut_items = -(-count // max(1, most // 2))
            room, found, c = max(1, most - count // cut_items), [], a
            # equal shares rather than full ones and a rest
            room = min(room, -(-int(upto[b] - upto[a]) // max(1, -(-int(upto[b] - upto[a]) // room))))
            while c < b:
                d = c + 1
                while d < b and upto[d + 1] - upto[c] <= room * 1.1:
                    d += 1
                cut_lines = max(1, -(-int(upto[d] - upto[c]) // int(room * 1.1 + 1)))
                found.append((c, d - 1, cut_items, cut_lines, regions))
                regions += cut_items * cut_lines
                c = d
            strips.append(Strip((i, j - 1), found))
        i = j
    return strips, regions


def join_region(items: dict[str, np.ndarray], lines: dict[str, np.ndarray], band: Band, top: int) -> dict[str, np.ndarray | list]:
    """Of each item with a pair here: n_pairs, gap_sum, lines_crc and its first pairs, as places in ``lines``' order.

    Ranges come from binary search among sorted values, sums from running sums; an item's own lines, found by a second binary
    search among lines in the order of items, are taken away.
    """
    order = np.lexsort((lines["item"], lines["line_no"], lines["sale_id"], lines["v"]))
    u, own, sale, no, crc = (lines[c][order] for c in ("v", "item", "sale_id", "line_no", "crc"))
    n, p, a = len(u), items["v"], items["item"]
    # sums of values on either side of p give the gaps; Python integers where they could overflow
    values = np.unique(u)
    at = np.arange(n)
    names, name = np.unique(own, return_inverse=True)
    rank = np.searchsorted(values, u)
    key = name.astype(np.int64) * (len(values) + 1) + rank
    by_item = np.argsort(key, kind="stable")
    key = key[by_item]

    def sums(x: np.ndarray) -> np.ndarray:
        wide = x.astype(object) if n and int(np.abs(x).max()) * n >= 1 << 62 else x.astype(np.int64)
        return np.concatenate([np.zeros(1, wide.dtype), np.cumsum(wide)])

    upto = {"u": sums(u), "crc": sums(crc)}
    upto_own = {"u": sums(u[by_item]), "crc": sums(crc[by_item])}
    place = lambda x: np.searchsorted(u, x, "left")
    lo, mid, hi = place(band.low(p)), place(p), np.searchsorted(u, band.high(p), "right")
    who = np.searchsorted(names, a)
    known = (who < len(names)) & (names[np.minimum(who, len(names) - 1)] == a)
    base = np.where(known, who, len(names)).astype(np.int64) * (len(values) + 1)
    own_place = lambda x, side: np.searchsorted(key, base + np.searchsorted(values, x, side), "left")
    olo, omid, ohi = own_place(band.low(p), "left"), own_place(p, "left"), own_place(band.high(p), "right")

    far = p.astype(object) if len(p) and int(np.abs(p).max()) * n >= 1 << 62 else p

    def gaps(upto_u, lo, mid, hi):
        below = far * (mid - lo) - (upto_u[mid] - upto_u[lo])
        return below + (upto_u[hi] - upto_u[mid]) - far * (hi - mid)

    pairs = (hi - lo) - (ohi - olo)
    keep = np.flatnonzero(pairs > 0)
    total = gaps(upto["u"], lo, mid, hi) - gaps(upto_own["u"], olo, omid, ohi)
    crcs = (upto["crc"][hi] - upto["crc"][lo]) - (upto_own["crc"][ohi] - upto_own["crc"][olo])
    # left of p the values fall, but equal values keep the order of their lines
    falling = np.lexsort((at, -u))

    def firsts(which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For items: the nearest lines on either side in order, which of them count, and whether a side goes on beyond an own line."""
        step = np.arange(width)
        left, right = (n - mid[which])[:, None] + step, mid[which][:, None] + step
        in_left, in_right = left < (n - lo[which])[:, None], right < hi[which][:, None]
        rows = np.concatenate([falling[np.minimum(left, n - 1)], np.minimum(right, n - 1)], axis=1)
        inside = np.concatenate([in_left, in_right], axis=1)
        mine = (own[rows] == a[which][:, None]) & inside
        # too few others on a side that has more lines: look again, wider
        short = np.zeros(len(which), bool)
        for side, end in ((slice(0, width), lo), (slice(width, None), hi)):
            more = (mid[which] - end[which] if end is lo else end[which] - mid[which]) > width
            short |= more & ((inside & ~mine)[:, side].sum(1) < top)
        gap = np.abs(u[rows] - p[which][:, None])
        gap[~inside | mine] = np.iinfo(np.int64).max
        best = np.argsort(gap, axis=1, kind="stable")[:, :top]  # of equal gaps the left one, which is smaller, comes first
        return np.take_along_axis(rows, best, 1), np.take_along_axis(inside & ~mine, best, 1), short

    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(keep)
    waiting, width = np.arange(len(keep)), top
    while len(waiting):
        again = []
        step = max(1, 400_000 // (2 * width))
        for i in range(0, len(waiting), step):
            part = waiting[i : i + step]
            rows, ok, short = firsts(keep[part], width)
            for k, row, good, bad in zip(part.tolist(), rows, ok, short.tolist(), strict=True):
                if bad:
                    again.append(k)
                else:
                    found[k] = row[good]
        waiting, width = np.array(again, np.int64), width * 4
    return {"keep": keep, "n_pairs": pairs[keep], "gap_sum": total[keep], "lines_crc": crcs[keep], "found": found, "u": u, "sale_id": sale, "line_no": no, "item": own}


FIRST = "array<struct<gap:bigint,u:bigint,sale_id:bigint,line_no:bigint,line_item_id:bigint>>"


def nearest_pairs(items: DataFrame, lines: DataFrame, band: Band = Band(), top: int = 10, partitions: int | None = None) -> DataFrame:
    """Each item's pairs with lines of other items whose value is within the band: the first ``top``, and sums over all.

    ``items``: (item_id, p); ``lines``: (sale_id, line_no, item_id, u), p and u integers. Returns item_id, p, n_pairs, gap_sum,
    lines_crc and first, an array of (gap, u, sale_id, line_no, line_item_id) in ascending order, a row for each row of ``items``.
    Null p, u, item_id or sale_id never pair; a null line_no is written as an empty text and comes first. Repeated lines each
    count, repeated items have a row each. Items without pairs have zeros and an empty array. Sums are 64-bit.
    """
    spark = items.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows have equal results, so each of them is looked up once
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("p").cast("bigint").alias("p")).groupBy("item_id", "p").agg(F.count("*").alias("times"))
    asked = wanted.where("p is not null and item_id is not null").select(F.col("item_id").alias("item"), F.col("p").alias("v"))
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    given = lines.where("u is not null and item_id is not null and sale_id is not null").select(
        F.col("item_id").cast("bigint").alias("item"), F.col("u").cast("bigint").alias("v"), F.col("sale_id").cast("bigint").alias("sale_id"),
        F.coalesce(F.col("line_no").cast("bigint"), F.lit(NONE)).alias("line_no"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    sides = []
    for side in (asked, given):
        counted = side.select("v", bucket(F.col("v")).alias("b")).groupBy("b").agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.count("*").alias("n"))
        sides.append(sorted(map(tuple, counted.collect())))  # at most BUCKETS rows
    histogram_items, histogram_lines = sides
    total = sum(x[3] for x in histogram_items) + sum(x[3] for x in histogram_lines)
    strips, regions = tile(histogram_items, histogram_lines, band, min(MOST, max(LEAST, total // max(1, partitions))))
    of_items, of_lines = [], []
    for strip in strips:
        for c0, c1, cut_items, cut_lines, first in strip.rectangles:
            of_items += [(histogram_items[r][0], first, cut_items, cut_lines) for r in range(strip.rows[0], strip.rows[1] + 1)]
            of_lines += [(histogram_lines[c][0], first, cut_items, cut_lines) for c in range(c0, c1 + 1)]
    empty = "item bigint, p bigint, n_pairs bigint, gap_sum bigint, lines_crc bigint, first " + FIRST + ", part int"
    merged = spark.createDataFrame([], empty) if not regions else _joined(spark, asked, given, of_items, of_lines, regions, partitions, band, top, empty)
    # partial results are merged a few at a time, so a cell cut into very many parts never meets in one group
    most_parts = max([cut for _, _, _, cut in of_items], default=1) * max((len(s.rectangles) for s in strips), default=1)
    merged = merged.withColumnRenamed("part", "g")
    while most_parts > FAN:
        merged = _merged(merged.withColumn("g", F.col("g") % (most_parts // FAN)), ["item", "p", "g"], top)
        most_parts //= FAN
    merged = _merged(merged, ["item", "p"], top).withColumnsRenamed({"item": "i", "p": "q"})
    out = wanted.join(merged, (F.col("item_id") == F.col("i")) & (F.col("p") == F.col("q")), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_pairs", "gap_sum", "lines_crc")}
    out = out.withColumns(zero | {"first": F.coalesce("first", F.array().cast(FIRST)), "copy": F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))})
    return out.select("item_id", "p", "n_pairs", "gap_sum", "lines_crc", "first")


def _merged(partial: DataFrame, by: list[str], top: int) -> DataFrame:
    together = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, top)
    return partial.groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("gap_sum").alias("gap_sum"), F.sum("lines_crc").alias("lines_crc"), together.alias("first"))


def _joined(spark, asked: DataFrame, given: DataFrame, of_items: list, of_lines: list, regions: int, partitions: int, band: Band, top: int, schema: str) -> DataFrame:
    """Partial results of every region. The rows that say which bucket goes where are bounded by the buckets, not by the input."""
    where = "b int, first_region bigint, cut_items bigint, cut_lines bigint"
    numbered = lambda side, rows: side.withColumn("b", bucket(F.col("v"))).join(F.broadcast(spark.createDataFrame(rows, where)), "b")
    # region = first + item's part * cuts of the lines + line's part; an item goes to all parts of the lines, and the other way round
    its = F.pmod(F.xxhash64("item", "v", "first_region"), F.col("cut_items")) * F.col("cut_lines")
    items = numbered(asked, of_items).withColumn("region", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cut_lines") - 1), lambda k: F.col("first_region") + its + k)))
    # equal lines are dealt apart too: the row's number in its partition is part of the draw
    drawn = F.pmod(F.xxhash64("sale_id", "line_no", "item", "crc", "nth"), F.col("cut_lines"))
    lines = numbered(given.withColumn("nth", F.monotonically_increasing_id()), of_lines).withColumn("region", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cut_items") - 1), lambda k: F.col("first_region") + k * F.col("cut_lines") + drawn)))
    none = F.lit(None).cast("bigint")
    both = items.select("region", F.lit(0).cast("tinyint").alias("side"), "v", "item", none.alias("sale_id"), none.alias("line_no"), none.alias("crc")).unionByName(
        lines.select("region", F.lit(1).cast("tinyint").alias("side"), "v", "item", "sale_id", "line_no", "crc"))
    tasks = min(regions, 4 * partitions)
    dealt = both.withColumn("task", (F.col("region") % tasks).cast("int")).repartitionById(tasks, F.col("task")).sortWithinPartitions("region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        region = None
        for batch in batches:
            at = np.asarray(batch.column("region"))
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            for s, e in zip(starts, [*starts[1:], len(at)], strict=True) if len(at) else ():
                if at[s] != region and held:
                    yield from partial(region, held)
                    held = []
                region = int(at[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from partial(region, held)

    def partial(region: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        side = whole.column("side").to_numpy()
        take = lambda which, names: {c: whole.column(c).to_numpy()[which].astype(np.int64) for c in names}
        mine, theirs = side == 0, side == 1
        if not mine.any() or not theirs.any():
            return
        its, rows = take(mine, ("v", "item")), take(theirs, ("v", "item", "sale_id", "line_no", "crc"))
        got = join_region(its, rows, band, top)
        keep = got["keep"]
        for i in range(0, len(keep), 10_000):
            part, found = keep[i : i + 10_000], got["found"][i : i + 10_000]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            rows_at = np.concatenate(found) if found else np.empty(0, np.int64)
            p = np.repeat(its["v"][part], np.diff(ends))
            fields = {"gap": np.abs(got["u"][rows_at] - p), "u": got["u"][rows_at], "sale_id": got["sale_id"][rows_at], "line_no": got["line_no"][rows_at], "line_item_id": got["item"][rows_at]}
            firsts = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields.values()], names=list(fields)))
            sums = [pa.array(got[c][i : i + 10_000].tolist(), pa.int64()) for c in ("n_pairs", "gap_sum", "lines_crc")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(its["item"][part]), pa.array(its["v"][part]), *sums, firsts, pa.array(np.full(len(part), region % (1 << 31), np.int32))],
                names=["item", "p", "n_pairs", "gap_sum", "lines_crc", "first", "part"])

    return dealt.drop("task").mapInArrow(tidy(run), schema)


def near_prices(items: DataFrame, lines: DataFrame, band: Band = Band(), top: int = 10) -> DataFrame:
    """Items against lines of near unit prices: (item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc).

    ``items``: (item_id, price); ``lines``: (sale_id, line_no, item_id, quantity, amount). An item has a row for each of its
    first ``top`` pairs, ranked from 1, or one row of rank 0. See ``nearest_pairs`` for nulls, ties and repeated rows; prices and amounts
    that are not finite, and lines with a quantity of 0, never pair. Other columns are left out.
    """
    found = nearest_pairs(
        items.select("item_id", cents(F.col("price")).alias("p")),
        lines.select("sale_id", "line_no", "item_id", F.when(F.col("quantity").isNotNull() & F.col("amount").isNotNull(), unit_cents(F.col("amount"), F.col("quantity"))).alias("u")),
        band, top)
    shown = found.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("first").alias("pos", "one"))
    return shown.select(
        "item_id", F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("rank"), "one.gap", "one.u", "one.sale_id",
        F.nullif(F.col("one.line_no"), F.lit(NONE)).alias("line_no"), "one.line_item_id", "n_pairs", "gap_sum", "lines_crc")


#: The join of ``near_prices`` with its usual band, in SQL. The checksum is folded over bytes and bits, with its published polynomial.
SQL = """
with li as (
  select sale_id, line_no, item_id, cast(floor(100 * amount + 0.5) as bigint) a, cast(quantity as bigint) q from sale_lines
  where sale_id is not null and item_id is not null and quantity is not null and quantity <> 0 and isfinite(amount)),
num as (select *, (2 * a + q) * sign(q)::bigint x, 2 * abs(q) y from li),
un as (select sale_id, line_no, item_id, (x - ((x % y) + y) % y) // y u,
  list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(concat(sale_id, ',', coalesce(line_no::varchar, ''), ',', item_id), ''), lambda c: ascii(c)::bigint)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) crc from num),
it as (select row_number() over () nth, item_id, case when isfinite(price) then cast(floor(100 * price + 0.5) as bigint) end p from items),
pairs as (select nth, abs(u - p) gap, u, sale_id, line_no, un.item_id line_item_id, xor(crc, 4294967295) crc
  from it join un on u >= least(p - 50, (200 * p) // 201 - 1) and u <= greatest(p + 50, p + p // 200 + 1)
  where it.item_id <> un.item_id and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * least(u, p))),
ranked as (select *, row_number() over (partition by nth order by gap, u, sale_id, line_no, line_item_id) as rank from pairs),
sums as (select nth, count(*) n_pairs, sum(gap) gap_sum, sum(crc) lines_crc from pairs group by nth)
select it.item_id, coalesce(rank, 0)::int as rank, gap, u, sale_id, line_no::bigint line_no, line_item_id,
  coalesce(n_pairs, 0)::bigint n_pairs, coalesce(gap_sum, 0)::bigint gap_sum, coalesce(lines_crc, 0)::bigint lines_crc
from it left join sums using (nth) left join (select * from ranked where rank <= 10) using (nth)
"""
