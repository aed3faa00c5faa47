"""Substring dedup by recompression: words that a repeat from an earlier document covers.

A window of ``width`` words is known by a symbol of the recompressed text (recompress_core): windows that are equal have
equal symbols, so only windows under a symbol that several documents share can repeat. Neighbouring windows under one
symbol make a segment. Symbols that one document alone has go first, by an aggregate of two ids for each symbol. Of the
rest, a segment whose words an earlier document has too is covered as a whole. What is left are segments that share
their symbol with other segments. Each of their windows is known by one of its halves, the one whose name is the least;
most symbols are shared by chance, and then no half is. Where one is, the windows themselves are compared.

Symbols gather candidates and decide nothing. Segments under one symbol and windows under one half are equal if keyed digests of their
words as written are (64 bits, beside the 64 of the symbol or half, under a key drawn anew for every call), so neither chance
nor a text made for it takes different words for equal.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, lean, release, slices, stored, tidy
from corpusloom.llm.recompress_core import GOLD, Words, mix, segments

OUT = "n_words bigint, n_removed bigint, kept_sha256 string"


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


#: Bytes of text that are worked on together.
TOGETHER = 1 << 20


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchors(width: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TOGETHER):
            words = Words(raw_texts(batch))
            keys, starts, ends, texts = segments(words, width)
            if len(keys):
                hashes = words.digests(starts, ends + width - 1, key)
                order = np.lexsort((hashes, keys, texts))
                keys, hashes, texts = keys[order], hashes[order], texts[order]
                new = np.ones(len(keys), bool)  # a text's repeats of a segment are one row
                new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
                ids = batch.column("id").take(pa.array(texts[new]))
                yield pa.RecordBatch.from_arrays([ids, long_array(keys[new]), long_array(hashes[new])], names=["doc", "key", "seg"])

    return run


def joint(symbols: np.ndarray, digests: np.ndarray, texts: np.ndarray | int = 0) -> np.ndarray:
    """One number for a symbol, a digest and a text's place in the batch; the digests' key keeps it unforeseeable."""
    return mix(digests.view(np.uint64) ^ mix(symbols.view(np.uint64) + np.asarray(texts, np.uint64) * GOLD))


def pairs_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The two fields of the structs in a column of lists, one list after the other."""
    flat = lists.flatten()
    return tuple(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))


def listed(batch: pa.RecordBatch, column: str, texts: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which (key, value) are in the list of such pairs that their own text has in a column."""
    lists = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(batch.num_rows), sizes)
    return np.isin(joint(keys, values, texts), joint(*pairs_of(lists), of))


def covered_words(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def halves_of(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """For each window that starts at a word the least name among its runs of half as many words."""
    half = (width + 1) // 2
    n = len(words.names) - half + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(half):
        runs = mix(runs * GOLD + words.names[k : k + len(runs)])
    least = runs[at]
    for k in range(1, width - half + 1):
        np.minimum(least, runs[at + k], out=least)
    return least


def _digest(raws: list[bytes], empty: list[bool], gone: list[np.ndarray | None], open_: list[bool], keep_text: bool) -> list[pa.Array]:
    """n_words, n_removed, kept_sha256 and kept of each text that isn't open."""
    out: list[tuple] = []
    for raw, null, lost, wait in zip(raws, empty, gone, open_, strict=True):
        if wait:
            out.append((None, None, None, None))
            continue
        words = raw.split()  # on bytes this takes the ASCII white space alone
        left = words if lost is None else list(compress(words, (~lost).tolist()))
        joined = b" ".join(left)
        kept = None
        if keep_text and not null:
            kept = (raw if len(left) == len(words) else joined).decode("utf-8", "replace")
        out.append((len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), kept))
    return [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]


def _judge(width: int, keep_text: bool, key: bytes):
    """Rows without pending segments are done. Of others go on a digest that tags the text, the text, compressed, the words
    that are gone (as positions), and place and half of every pending window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text", TOGETHER):
            raws, n = raw_texts(batch), batch.num_rows
            known = np.array([bool(c or p) for c, p in zip(pa.compute.list_value_length(batch.column("covered")).to_pylist(), pa.compute.list_value_length(batch.column("pending")).to_pylist(), strict=True)], bool)
            gone: list[np.ndarray | None] = [None] * n
            lost: list[np.ndarray | None] = [None] * n
            places: list[np.ndarray | None] = [None] * n
            halves: list[np.ndarray | None] = [None] * n
            if known.any():
                words = Words([r if k else b"" for r, k in zip(raws, known, strict=True)])
                keys, starts, ends, texts = segments(words, width)
                hashes = words.digests(starts, ends + width - 1, key) if len(keys) else keys
                whole, pending = listed(batch, "covered", texts, keys, hashes), listed(batch, "pending", texts, keys, hashes)
                count, offsets = len(words.names), words.offsets
                mask = covered_words(starts[whole], ends[whole] + width - 1, count)
                at = np.flatnonzero(covered_words(starts[pending], ends[pending], count))
                found = halves_of(words, at, width).view(np.int64)
                first, last = np.searchsorted(at, offsets[:-1]), np.searchsorted(at, offsets[1:])
                for i in np.flatnonzero(known):
                    a, b = offsets[i], offsets[i + 1]
                    if mask[a:b].any():
                        gone[i] = mask[a:b]
                    if last[i] > first[i]:
                        part = slice(first[i], last[i])
                        places[i], halves[i] = at[part] - a, found[part]
                        lost[i] = np.flatnonzero(mask[a:b])
            open_ = [p is not None for p in places]
            tags = [int.from_bytes(hashlib.blake2b(r, digest_size=8, key=key).digest(), "little", signed=True) if wait else None for r, wait in zip(raws, open_, strict=True)]
            text = pa.array([squeeze(r) if wait else None for r, wait in zip(raws, open_, strict=True)], pa.binary())
            lists = [pa.array(x, pa.list_(t)) for x, t in ((lost, pa.int32()), (places, pa.int32()), (halves, pa.int64()))]
            done = _digest(raws, batch.column("text").is_null().to_pylist(), gone, open_, keep_text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tags, pa.int64()), text, *lists, *done], names=["row", "tag", "text", "lost", "places", "halves", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _windows(width: int, key: bytes):
    """A row for each pending window under a half that several documents have: its place, half and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "text", TOGETHER >> 1):
            words = Words([expand(t) for t in batch.column("text").to_pylist()])
            out: list[tuple[np.ndarray, ...]] = []
            for i, (places, halves, shared) in enumerate(zip(*(batch.column(c) for c in ("places", "halves", "shared")), strict=True)):
                own, place = np.array(halves.values, np.int64), np.array(places.values, np.int64)
                hit = np.isin(own, np.array(shared.values, np.int64))
                out.append((np.full(int(hit.sum()), i), place[hit], own[hit], place[hit] + words.offsets[i]))
            row, place, half, at = map(np.concatenate, zip(*out, strict=True))
            if len(row):
                of = pa.array(row)
                numbers = [pa.array(place.astype(np.int32)), pa.array(half), long_array(words.digests(at, at + width, key))]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(of), batch.column("tag").take(of), *numbers], names=["doc", "tag", "place", "half", "window"])

    return run


def _finish(width: int, keep_text: bool):
    """The rest: a pending window that an earlier document has takes its words too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "text", TOGETHER >> 1):
            raws, gone = [expand(t) for t in batch.column("text").to_pylist()], []
            for raw, lost, hits in zip(raws, *(batch.column(c) for c in ("lost", "hits")), strict=True):
                change = np.zeros(len(raw) + 2, np.int32)
                out = np.array(lost.values) if lost.is_valid else np.empty(0, np.int32)
                np.add.at(change, out, 1)
                np.add.at(change, out + 1, -1)
                if hits.is_valid:
                    at = np.array(hits.values)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + width, -1)
                gone.append(np.cumsum(change) > 0)
            none = [False] * len(raws)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *_digest(raws, none, gone, none, keep_text)], names=["row", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with its other columns, and n_words, n_removed, kept_sha256 and, on request, kept.

    A word goes if a window of ``width`` words that covers it also starts in a row with a smaller id; windows are judged
    on the input. kept_sha256 is the digest of what is left, joined by one space; kept is that, or the text as it was if it
    loses nothing. A null, empty or blank text has
    no words; a text shorter than a window loses none. Rows that repeat an id don't count against each other; a row
    with a null id loses nothing and counts against none. The text column itself is not returned. Extra columns of any
    name pass through untouched (n_words, n_removed, kept_sha256 and kept replace columns of these names).

    Shuffled are a symbol, a hash and an id for about every seventh word, the texts once, and compressed those of texts that
    share symbols but not whole segments, twice more.
    """
    own = {"n_words", "n_removed", "kept_sha256", "kept", text_col}
    others = [c for c in docs.columns if c not in own]
    base = lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    kind, row_type = base.schema["id"].dataType.simpleString(), base.schema["row"].dataType.simpleString()

    key = os.urandom(16)
    anchors = base.where("id is not null").select("id", "text").mapInArrow(tidy(_anchors(width, key)), f"doc {kind}, key bigint, seg bigint")
    # tables are stored before they meet, so that adaptive execution can split the join where a key is hot
    anchors = stored(anchors, "anchors")
    ends = stored(anchors.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key"), "ends")
    shared = stored(anchors.join(ends.hint("merge"), "key"), "shared")
    discard(anchors, ends)
    release(base.sparkSession, 0.0)
    firsts = stored(shared.groupBy("key", "seg").agg(F.min("doc").alias("first")), "firsts")
    covered = shared.join(firsts.hint("merge"), ["key", "seg"]).where("doc > first").select("doc", "key", "seg", F.lit(True).alias("whole"))
    several = firsts.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("first").alias("high")).where("n > 1 and low < high").select("key")
    pending = firsts.join(several.hint("merge"), "key").select(F.col("first").alias("doc"), "key", "seg", F.lit(False).alias("whole"))
    of = F.struct("key", "seg")
    lists = covered.unionByName(pending).groupBy("doc").agg(F.collect_list(F.when(F.col("whole"), of)).alias("covered"), F.collect_list(F.when(~F.col("whole"), of)).alias("pending"))
    first_out = f"row {row_type}, tag bigint, text binary, lost array<int>, places array<int>, halves array<bigint>, {OUT}, kept string"
    joined = base.join(lists.hint("merge"), base["id"] == lists["doc"], "left").select("row", "text", "covered", "pending")
    judged = stored(joined.mapInArrow(tidy(_judge(width, keep_text, key)), first_out), "judged")
    discard(shared, firsts)
    release(base.sparkSession, 0.0)

    def both_ends(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")

    open_rows = judged.where("tag is not null")
    of_doc = open_rows.select(F.col(f"row.`{id_col}`").alias("doc"), "tag", "text", "places", "halves")
    sides = of_doc.select("doc", F.explode(F.array_distinct("halves")).alias("half"))
    repeated = stored(both_ends(sides, "half").select("half"), "halves")
    shared_halves = sides.join(repeated.hint("merge"), "half").groupBy("doc").agg(F.collect_set("half").alias("shared"))
    windows = of_doc.join(shared_halves, "doc").mapInArrow(tidy(_windows(width, key)), f"doc {kind}, tag bigint, place int, half bigint, window bigint")
    windows = stored(windows, "windows")
    earliest = stored(both_ends(windows, "half", "window"), "earliest")
    hits = windows.join(earliest.hint("merge"), ["half", "window"]).where("doc > first").groupBy("doc", "tag").agg(F.collect_set("place").alias("hits"))
    hits = stored(hits.withColumnsRenamed({"tag": "of"}), "hits")
    discard(windows, earliest, repeated)
    rest = open_rows.select("row", "tag", "text", "lost").join(hits, (F.col(f"row.`{id_col}`") == F.col("doc")) & (F.col("tag") == F.col("of")), "left").select("row", "text", "lost", "hits")
    rest = rest.mapInArrow(tidy(_finish(width, keep_text)), f"row {row_type}, {OUT}, kept string")
    done = judged.where("tag is null").select("row", "n_words", "n_removed", "kept_sha256", "kept").unionByName(rest)
    return done.select("row.*", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else []))
