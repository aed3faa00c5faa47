"""Packing of token ids into sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids are cut into full sequences and a rest. Rests go to groups drawn by random numbers. In a group the rests are
placed by falling length, each into the first sequence with room; a tournament tree over the sequences' room finds it in
logarithmic time. What room is left is then filled by cutting rests of the emptiest sequences, and the one sequence that is
neither full nor empty at the end is cut at powers of two, which need no padding. So a group has no padding at all, and at
most one cut more than it has sequences that first-fit left with a gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices, stored, tidy
from corpusloom.llm.token_ids import byte_ids

#: Documents in a group, about.
GROUP = 2_000
#: A group's sequences are numbered within this many.
NUMBERS = 1 << 32


class TournamentTree:
    """Room of bins in order; a node holds the larger room of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it; the bin's number."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Of equal sizes the earlier item comes first."""
    tree, bins = TournamentTree(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def powers(n: int) -> list[int]:
    """The powers of two that sum up to n, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def fill(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) without padding: gaps are filled from the emptiest bins, the last rest is cut at powers of two."""
    need = lambda b: sum(x[2] for x in b)
    whole = [b for b in bins if (n := need(b)) == capacity or n & (n - 1) == 0]
    rest = sorted((b for b in bins if (n := need(b)) != capacity and n & (n - 1)), key=need, reverse=True)
    front, room = 0, 0
    while front < len(rest):
        room = capacity - need(rest[front])
        while room and front < len(rest) - 1:
            last = rest[-1]
            item, start, length = last.pop()
            take = min(room, length)
            rest[front].append((item, start, take))
            if take < length:
                last.append((item, start + take, length - take))
            room -= take
            if not last:
                rest.pop()
        whole_one = rest[front]
        front += 1
        if room:  # the only one that is left
            for size in powers(need(whole_one)):
                part = []
                while size:
                    item, start, length = whole_one.pop(0)
                    take = min(size, length)
                    part.append((item, start, take))
                    if take < length:
                        whole_one.insert(0, (item, start + take, length - take))
                    size -= take
                whole.append(part)
        else:
            whole.append(whole_one)
    return whole


def mixed(partition: int, first: int, n: int) -> np.ndarray:
    """n pseudo-random 63-bit numbers for rows ``first`` and on of a partition: always the same for the same place."""
    x = (np.arange(first, first + n, dtype=np.uint64) + (np.uint64(partition) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None, capacity: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Each row's ids, cut: id, doc_tokens, the checksums (or ids) of the full sequences, the rest's ids, and a random number."""
    key = docs.schema[id_col].dataType.simpleString()
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, partition = byte_ids(vocabulary), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            tokens, full, rest = [], [], []
            for text in batch.column("text").to_pylist():
                raw = (bpe.ids(text).tobytes() if text else b"") + tail
                tokens.append(len(raw) // 4)
                cut = len(raw) - len(raw) % step
                full.append(raw[:cut] if keep_ids else b"".join(zlib.crc32(raw[i : i + step]).to_bytes(4, "little") for i in range(0, cut, step)))
                rest.append(raw[cut:])
            draw = mixed(partition, seen, len(tokens)).astype(np.int64)
            seen += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(tokens, pa.int64()), pa.array(full, pa.binary()), pa.array(rest, pa.binary()), pa.array(draw)],
                names=["id", "doc_tokens", "full", "rest", "draw"])

    return lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {key}, doc_tokens bigint, full binary, rest binary, draw bigint")


def pack(docs: DataFrame, vocabulary: str, end_id: int | None = None, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, group: int = GROUP) -> DataFrame:
    """A row for each piece of each row of ``docs``, in sequences of at most ``capacity`` ids.

    Returns the id, start (ids of the document before), length, ids_crc32 (unsigned, of little-endian 32-bit ids), doc_tokens,
    sequence_id, offset in the sequence, sequence_tokens, and the piece's ids on request. ``end_id`` is added to every document. Every
    sequence has ``capacity`` ids or a power of two of them, so none is padded.

    A null text counts as empty; without an end id a text without ids has no piece. Each row is a document of its own, also if rows
    repeat or ids are null; other columns are left out. Encoding runs where the rows are, and its result is stored, so a lost
    executor can't deal rows anew. Only rests and checksums are shuffled. A task holds one group: about ``group`` rests, and a
    number for each full sequence.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    rows = stored(encoded(docs, vocabulary, end_id, capacity, id_col, text_col, keep_ids), "packing")
    groups = max(1, -(-rows.count() // group))
    tasks = max(1, min(groups, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("g", F.pmod("draw", F.lit(groups))).withColumn("task", (F.col("g") % tasks).cast("int")).repartitionById(tasks, F.col("task"))
    step = 4 * capacity if keep_ids else 4

    def packed(g: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        ids, tokens, full, rest = (whole.column(c).to_pylist() for c in ("id", "doc_tokens", "full", "rest"))
        some = [i for i, raw in enumerate(rest) if raw]
        bins = [[(some[k], 0, len(rest[some[k]]) // 4) for k in b] for b in first_fit_decreasing([len(rest[i]) // 4 for i in some], capacity)] if some else []
        out: dict[str, list] = {c: [] for c in ("id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids")}
        number = g * NUMBERS

        def add(i: int, start: int, length: int, crc: int, offset: int, size: int, raw: bytes | None) -> None:
            for c, v in zip(out, (ids[i], start, length, crc, tokens[i], number, offset, size, raw), strict=True):
                out[c].append(v)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(out[c], whole.schema.field("id").type if c == "id" else pa.int64()) for c in list(out)[:-1]]
            if keep_ids:
                ends = np.cumsum([0, *out["length"]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out["ids"]), np.int32))))
            names = [id_col, "start", "length", "ids_crc32", *list(out)[4:-1]] + ["ids"] * keep_ids
            for c in out:
                out[c] = []
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for i, raw in enumerate(full):
            for k in range(0, len(raw), step):
                part = raw[k : k + step]
                add(i, k // step * capacity, capacity, zlib.crc32(part) if keep_ids else int.from_bytes(part, "little"), 0, capacity, part if keep_ids else None)
                number += 1
                if len(out["id"]) >= 5_000:
                    yield flush()
        for bin_ in fill(bins, capacity):
            offset, size = 0, sum(x[2] for x in bin_)
            for i, start, length in bin_:
                raw = rest[i][4 * start : 4 * (start + length)]
                add(i, tokens[i] - len(rest[i]) // 4 + start, length, zlib.crc32(raw), offset, size, raw if keep_ids else None)
                offset += length
            number += 1
        yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, g = [], None
        for batch in batches:
            at = np.asarray(batch.column("g"))
            starts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()] if len(at) else []
            for s, e in zip(starts, [*starts[1:], len(at)], strict=True) if starts else ():
                if at[s] != g and held:
                    yield from packed(g, held)
                    held = []
                g = int(at[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from packed(g, held)

    schema = f"{id_col} {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint" + (", ids array<int>" if keep_ids else "")
    return dealt.drop("task").sortWithinPartitions("g", "draw").mapInArrow(tidy(run), schema)
