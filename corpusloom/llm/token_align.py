"""Alignment of two tokenizers over the same bytes.

Every byte of a text has a label: no token ends there, one of A does, one of B does, or one of both. A regular expression
cuts the labels into spans up to each byte where both end; the labels counted in a span say how many tokens of A and of B
form a group. Two tokens of a group are linked. How many documents hold a pair of ids linked is counted for the whole corpus,
and each document's links are measured by these counts.

Documents are worked on in blocks of neighbours. A block names its pairs of ids once, so what is shuffled for the counts, and
comes back from them, is a row for each pair of a block instead of one for each link of a document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices, stored, tidy
from corpusloom.llm.token_ids import byte_ids

#: Bytes of text in a block, or one longer document; links of a group that are listed by themselves rather than by distinct ids.
BLOCK, FEW = 2 << 20, 256
#: Labels: bit 1 where a token of A ends, bit 2 where one of B does.
SPANS = re.compile(rb"[^\x03]*\x03").findall
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass
class Groups:
    """Token groups of some texts put together: of each text whether it has tokens, ids, tokens of either side in each group, and where groups end."""

    has: np.ndarray
    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    ends: np.ndarray
    #: Of each text with tokens: where its tokens of A and B, its groups and its bytes end.
    upto_a: np.ndarray
    upto_b: np.ndarray
    upto_groups: np.ndarray
    upto_bytes: np.ndarray


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.bpe = byte_ids(a_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a = self.bpe.exact.token_bytes
        size = self.pieces.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(size))]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # decimal ids with what follows them: in a group, at the end of A's part, at the end of the group
        self.shown_a = np.array([[f"{i}{end}" for i in range(len(self.bytes_a))] for end in ",|"], object)
        self.shown_b = np.array([[f"{i}{end}" for i in range(size)] for end in ",;"], object)

    def groups(self, texts: list[str | None]) -> Groups:
        has, a_ids, b_ids, sizes = np.zeros(len(texts), bool), [], [], []
        b_all = self.pieces.encode([t or "" for t in texts], num_threads=1)
        for i, text in enumerate(texts):
            if not text:
                continue
            whole = b" " + text.encode()
            a = self.bpe.plain(" " + text)
            if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b_all[i])) != whole:
                continue
            has[i] = True
            a_ids.append(a)
            b_ids.append(np.array(b_all[i], np.uint32))
            sizes.append(len(whole))
        upto = lambda parts: np.cumsum([0, *parts])
        together = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        a, b, upto_bytes = together(a_ids), together(b_ids), upto(sizes)
        labels = np.zeros(upto_bytes[-1], np.uint8)
        labels[np.cumsum(self.length_a[a]) - 1] |= 1
        labels[np.cumsum(self.length_b[b]) - 1] |= 2
        spans = SPANS(labels.tobytes())
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        del spans
        seen = [np.cumsum(labels & 1, dtype=np.int64), np.cumsum(labels >> 1, dtype=np.int64)]
        in_a, in_b = (np.diff(s[ends - 1], prepend=0) if len(ends) else np.empty(0, np.int64) for s in seen)
        return Groups(has, a, b, in_a, in_b, ends, upto(map(len, a_ids)), upto(map(len, b_ids)), np.searchsorted(ends, upto_bytes, "right"), upto_bytes)

    def digests(self, g: Groups) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` of each text with tokens."""
        last_a, last_b = np.zeros(len(g.a), np.int64), np.zeros(len(g.b), np.int64)
        last_a[np.cumsum(g.in_a) - 1] = 1
        last_b[np.cumsum(g.in_b) - 1] = 1
        before_b, through_a = np.cumsum(g.in_b) - g.in_b, np.cumsum(g.in_a)
        out = np.empty(len(g.a) + len(g.b), object)
        out[np.arange(len(g.a)) + np.repeat(before_b, g.in_a)] = self.shown_a[last_a, g.a]
        out[np.arange(len(g.b)) + np.repeat(through_a, g.in_b)] = self.shown_b[last_b, g.b]
        cuts = (g.upto_a + g.upto_b).tolist()
        return [hashlib.sha256("".join(out[s:e].tolist())[:-1].encode()).hexdigest() for s, e in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def links(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text with tokens, id of A << 32 | id of B, times) of linked tokens; a pair can come up again.

    Small groups list their links; large ones list their distinct ids with the product of their numbers.
    """
    start_a, start_b = np.cumsum(g.in_a) - g.in_a, np.cumsum(g.in_b) - g.in_b
    text = np.repeat(np.arange(len(g.upto_groups) - 1), np.diff(g.upto_groups))
    many = g.in_a * g.in_b
    few = np.flatnonzero(many <= FEW)
    group = np.repeat(few, many[few])
    nth = np.arange(len(group)) - np.repeat(np.cumsum(many[few]) - many[few], many[few])
    y = g.in_b[group]
    pairs = [g.a[start_a[group] + nth // y] << 32 | g.b[start_b[group] + nth % y]]
    texts, times = [text[group]], [np.ones(len(group), np.int64)]
    for k in np.flatnonzero(many > FEW).tolist():
        a, n_a = np.unique(g.a[start_a[k] : start_a[k] + g.in_a[k]], return_counts=True)
        b, n_b = np.unique(g.b[start_b[k] : start_b[k] + g.in_b[k]], return_counts=True)
        pairs.append(((a << 32)[:, None] | b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
        texts.append(np.full(len(pairs[-1]), text[k]))
    return np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)


def squeeze(x: np.ndarray) -> tuple[bytes, bytes]:
    """Non-negative numbers, mostly small: a byte each, and 8 bytes for those from 255 on."""
    return np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype("<i8").tobytes()


def unsqueeze(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<i8")
    return out


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The count of a pair of ids is the number of rows of the corpus that hold it linked; n_best is how many links have a count that
    no pair of their id of A exceeds, count_sum sums up the counts of all links. Texts that are null or empty, or whose tokens don't
    spell space + text, have no tokens: zeros and ''. Repeated rows each count; other columns are left out. Tokens are found once,
    in any partitioning; a task holds a block of texts.
    """
    key = docs.schema[id_col].dataType.simpleString()
    rows = f"block bigint, pair bigint, nth int, held int, id {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, small binary, large binary, times binary, many binary"
    fields = ["block", "pair", "nth", "held", "id", *COUNTS, "groups_sha256", "small", "large", "times", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK):
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), batch.schema.field("id").type, *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4]
            g = al.groups(batch.column("text").to_pylist())
            n = int(g.has.sum())
            text, pair, times = links(g)
            known, name = np.unique(pair, return_inverse=True)
            own, where = np.unique(text * max(1, len(known)) + name, return_inverse=True)
            times = np.bincount(where, times, len(own)).astype(np.int64)
            text, name = np.divmod(own, max(1, len(known)))
            held = np.bincount(name, minlength=len(known))
            cuts = np.searchsorted(text, np.arange(n + 1))
            sums = np.diff(np.concatenate([[0], np.cumsum(times)])[cuts])
            for i in range(0, len(known), 50_000):
                part = slice(i, i + 50_000)
                m = len(known[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), pa.array(known[part]), pa.array(np.arange(i, i + m, dtype=np.int32)), pa.array(held[part].astype(np.int32)), *(pa.nulls(m, t) for t in types[4:])], names=fields)
            packed = [(*squeeze(np.diff(name[s:e], prepend=0)), *squeeze(times[s:e])) for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            per = {"n_a": np.diff(g.upto_a), "n_b": np.diff(g.upto_b), "n_groups": np.diff(g.upto_groups), "n_links": sums}
            out = {c: np.zeros(len(g.has), np.int64) for c in per}
            for c, v in per.items():
                out[c][g.has] = v
            shas, blobs = iter(al.digests(g)), iter(packed)
            found = [(next(shas), *next(blobs)) if has else ("", b"", b"", b"", b"") for has in g.has.tolist()]
            size = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)), *(pa.nulls(size, t) for t in types[1:4]), batch.column("id"), *(pa.array(out[c]) for c in COUNTS), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types[9:]))], names=fields)
            block += 1

    whole = stored(lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), rows), "aligned")
    pairs = whole.where("pair is not null").select("block", "pair", "nth", "held")
    texts = whole.where("pair is null").drop("pair", "nth", "held")
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("docs"))
    # a row for each id of A's vocabulary at most
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    counts = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    looked = pairs.join(counts, "pair").select(F.col("block").alias("of"), "nth", "docs", "best")

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("nth").to_numpy(), kind="stable")
        docs, best = found.column("docs").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        n_best, total = [], []
        for small, large, times, many in zip(*(texts.column(c).to_pylist() for c in ("small", "large", "times", "many")), strict=True):
            nth, times = np.cumsum(unsqueeze(small, large)), unsqueeze(times, many)
            n_best.append(int((best[nth] * times).sum()))
            total.append(int((docs[nth] * times).sum()))
        kept = texts.select(["id", *COUNTS]).rename_columns([id_col, *COUNTS])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", texts.column("groups_sha256"))

    schema = f"{id_col} {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return texts.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(score, schema)


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each group: the id, nth (from 0), start and end in the bytes of space + text, and the ids a and b. Texts without tokens have none."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for batch in slices(batches, "text", BLOCK):
            g = al.groups(batch.column("text").to_pylist())
            per = np.diff(g.upto_groups)
            first = np.repeat(g.upto_groups[:-1], per)
            base = np.repeat(g.upto_bytes[:-1], per)
            starts = np.concatenate([[0], g.ends[:-1]]) if len(g.ends) else g.ends
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(ids.astype(np.int32))) for n, ids in ((g.in_a, g.a), (g.in_b, g.b))]
            ids = batch.column("id").filter(pa.array(g.has)).take(pa.array(np.repeat(np.arange(len(per)), per)))
            whole = pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(first)) - first), pa.array(starts - base), pa.array(g.ends - base), *lists], names=[id_col, "nth", "start", "end", "a", "b"])
            for i in range(0, whole.num_rows, 50_000):
                yield whole.slice(i, 50_000)

    schema = f"{id_col} {key}, nth bigint, start bigint, end bigint, a array<int>, b array<int>"
    return lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
