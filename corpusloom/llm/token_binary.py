"""Token ids in a compact binary form, in the order of document ids.

The file format: Parquet files of frames. A frame holds whole documents in ascending order of id, about FRAME token ids or
one longer document. Its column ``frame`` is, little-endian:

    magic "CLF2", ids in the vocabulary (u32), documents n (u32), blocks m (u32), flags of null ids (n bytes),
    document ids (n x i64), tokens of each document (n x u32), then for each block its tokens, bytes of code and CRC-32 of
    its ids (m x 3 x u32), then the codes.

Blocks are coded by ``stream_coder`` from a reset model each, so a damaged block is found by its checksum and loses nothing
else. Files with magic "CLF1" are the same with blocks coded by ``lane_coder``; they are read as well. Columns ``piece`` and ``nth`` order the frames, ``n_tokens`` counts their ids.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import lane_coder
from corpusloom.llm.bpe_prefix import PLAIN_END, SPACE, Memo, byte_names, plain_classes
from corpusloom.llm.common import in_pieces, shared_dir, slices, tidy
from corpusloom.llm.stream_coder import BLOCK, decode_blocks, encode_blocks

MAGIC, FIRST_MAGIC = b"CLF2", b"CLF1"
#: Ids in a frame, and blocks that are coded together.
FRAME, LANES = 64 * BLOCK, 512
#: Pieces that a worker remembers, their bytes, and the most ids of one that is kept when others go.
KNOWN, KNOWN_BYTES, LONG = 300_000, 32 << 20, 64


class Known:
    """Ids of pieces met before, in arrays; beyond KNOWN pieces or KNOWN_BYTES the half that was not met for longest goes, and long ones."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode, self.turn = encode, 0
        self.pieces, self.ids = pa.array([], pa.binary()), np.empty(0, np.int32)
        self.sizes, self.met = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin and how many they are. The pieces are different ones."""
        self.turn += 1
        at = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.pieces) + np.arange(len(new))
            fresh = pieces.take(pa.array(new))
            made = [self.encode(piece) for piece in fresh.to_pylist()]
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(made), np.int32)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made))])
            self.met = np.concatenate([self.met, np.zeros(len(made), np.int64)])
        self.met[at] = self.turn
        out = self.ids, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        if len(self.pieces) > KNOWN or self.pieces.nbytes > KNOWN_BYTES:
            keep = (self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]) & (self.sizes <= LONG)
            self.ids = self.ids[np.repeat(keep, self.sizes)]
            self.pieces, self.sizes, self.met = self.pieces.filter(pa.array(keep)), self.sizes[keep], self.met[keep]
        return out


class WordTokenizer:
    """The tokenizers library on pieces, each encoded once: the vocabulary's split keeps pieces apart.

    Texts with characters whose lower case or composition depends on their neighbours, or with strings of added tokens,
    go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters, digits = plain_classes()
        with open(path, encoding="utf-8") as f:
            split = next(x["pattern"]["Regex"] for x in json.load(f)["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # the vocabulary's own split, with its classes written out for characters below PLAIN_END
        for name, inside in (("L", letters), ("N", digits)):
            split = split.replace(f"\\p{{{name}}}", inside)
        self.pieces = re.compile(split.replace("\\s", SPACE)).findall
        self.odd = re.compile(rf"[^\x00-\u{PLAIN_END - 1:04x}]").search
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # pieces are normal and split already, so the library's model takes them, in the characters that its vocabulary writes for bytes
        model, shown = self.tokenizer.model, {b: c for c, b in byte_names().items()}
        piece_ids = lambda raw: [t.id for t in model.tokenize(raw.decode() if raw.isalpha() else "".join([shown[b] for b in raw]))]
        self.memo = Memo(piece_ids)
        self.known = Known(lambda raw: piece_ids(raw if raw.isascii() else raw.decode("latin-1").encode()))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a one-byte character's kind: 0 white space, 1 letter, 2 number, 3 anything else
        self.kinds = np.array([0 if re.match(f"[{SPACE}]", chr(c)) else 1 if re.match(f"[{letters}]", chr(c)) else 2 if re.match(f"[{digits}]", chr(c)) else 3 for c in range(256)], np.uint8)
        self.short = re.compile(r"'(?:[stmd]|re|ve|ll)".encode())

    def encode(self, text: str) -> np.ndarray:
        lower = text.lower()
        # some characters have a lower case beyond the classes; "i̇" is one character's, which the library writes as two
        if self.odd(text) or self.odd(lower) or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pieces(lower))), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts of one-byte characters are split together, and each of their different pieces is encoded once."""
        found: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        many = []
        for i, text in enumerate(texts):
            if (text.isascii() or one_byte(text)) and not any(a in text for a in self.added):
                many.append(i)
            elif text:
                found[i] = self.encode(text)
        if not many:
            return found
        raw = "\n".join([texts[i] for i in many]).lower().encode("latin-1")
        chars = np.frombuffer(raw, np.uint8)
        kind = self.kinds.take(chars)
        start = np.empty(len(chars), bool)
        start[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == 2  # each number alone
        for match in self.short.finditer(raw):
            i, end = match.span()
            if i == 0 or kind[i - 1] != 3:  # it doesn't go on with a run of signs
                start[i + 1] = False
                start[end : end + 1] = True
        inside = kind != 0
        start &= inside
        at = np.flatnonzero(start)  # where pieces begin, with white space
        begins = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(begins), pa.py_buffer(chars[inside])]).dictionary_encode()
        known, first, count = self.known.find(pieces.dictionary)
        which = pieces.indices.to_numpy()
        first, count = first.take(which), count.take(which)
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = known.take(np.repeat(first - upto[:-1], count) + np.arange(upto[-1]))
        ends = np.cumsum([len(texts[i]) + 1 for i in many])
        for i, own in zip(many, np.split(ids, upto[np.searchsorted(at, ends[:-1])]), strict=True):
            found[i] = own
        return found


def one_byte(text: str) -> bool:
    """Whether all characters are below 256; their lower cases are then as well."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pack(frames: list[tuple[list, list[np.ndarray]]], ids: int) -> list[tuple[int, int, bytes]]:
    """(documents, tokens, bytes) of frames of (document ids, ids of each document)."""
    blocks, heads = [], []
    for names, parts in frames:
        whole = np.concatenate(parts) if parts else np.empty(0, np.int32)
        own = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
        heads.append((names, [len(p) for p in parts], len(whole), len(own)))
        blocks += own
    codes = [c for i in range(0, len(blocks), LANES) for c in encode_blocks(blocks[i : i + LANES], ids)]
    out, at = [], 0
    for names, counts, tokens, m in heads:
        mine, code = blocks[at : at + m], codes[at : at + m]
        at += m
        table = np.array([[len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())] for b, c in zip(mine, code, strict=True)], "<u4").reshape(-1, 3)
        nulls = bytes(name is None for name in names)
        body = MAGIC + struct.pack("<III", ids, len(names), m) + nulls + np.array([n or 0 for n in names], "<i8").tobytes() + np.array(counts, "<u4").tobytes()
        out.append((len(names), tokens, body + table.tobytes() + b"".join(code)))
    return out


def unpack(frames: list[bytes]) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The (document id, ids) of each frame. Raises ValueError for what isn't a frame or doesn't match its checksum."""
    heads, codes, counts, sums, sizes, forms = [], [], [], [], set(), []
    for raw in frames:
        if raw[:4] not in (MAGIC, FIRST_MAGIC):
            raise ValueError("not a frame of token ids")
        ids, n, m = struct.unpack_from("<III", raw, 4)
        sizes.add(ids)
        forms += [raw[:4]] * m
        at = 16
        nulls = raw[at : at + n]
        names = np.frombuffer(raw, "<i8", n, at := at + n)
        lengths = np.frombuffer(raw, "<u4", n, at := at + 8 * n)
        table = np.frombuffer(raw, "<u4", 3 * m, at := at + 4 * n).reshape(-1, 3)
        at += 12 * m
        for count, size, crc in table.tolist():
            codes.append(raw[at : at + size])
            counts.append(count)
            sums.append(crc)
            at += size
        heads.append(([None if null else int(x) for null, x in zip(nulls, names, strict=True)], lengths, m))
    if len(sizes) > 1:
        raise ValueError("frames of different vocabularies")
    blocks: list[np.ndarray] = [np.empty(0, np.int32)] * len(codes)
    for magic, decode in ((MAGIC, decode_blocks), (FIRST_MAGIC, lane_coder.decode_blocks)):
        own = [i for i, form in enumerate(forms) if form == magic]
        for some in (own[i : i + LANES] for i in range(0, len(own), LANES)):
            for i, block in zip(some, decode([codes[i] for i in some], [counts[i] for i in some], ids), strict=True):
                blocks[i] = block
    for block, crc in zip(blocks, sums, strict=True):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError("a block doesn't match its checksum")
    at = 0
    for names, lengths, m in heads:
        whole = np.concatenate(blocks[at : at + m]) if m else np.empty(0, np.int32)
        at += m
        yield list(zip(names, np.split(whole, np.cumsum(lengths)[:-1].astype(int)) if len(lengths) else [], strict=True))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text, add ``end_id`` if given, and write the files to ``path`` in ascending order of id.

    A null text counts as empty; a null id comes first; rows that repeat an id stand in the order of their texts. Ids are
    64-bit integers. Rows go to ranges of ids, so texts are shuffled once and the driver holds a number for each range.
    """
    rows, pieces = in_pieces(docs, id_col, text_col)
    rows = rows.repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", "at", F.col("text").asc_nulls_first())
    tail = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        ready: list[tuple[int, int, list, list[np.ndarray]]] = []
        piece, nth, names, parts, size, waiting = None, 0, [], [], 0, 0

        def close() -> None:
            nonlocal nth, names, parts, size, waiting
            if names:
                ready.append((piece, nth, names, parts))
                waiting += size
                nth, names, parts, size = nth + 1, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ready, waiting
            packed = pack([(r[2], r[3]) for r in ready], tokenizer.size)
            columns = [[r[0] for r in ready], [r[1] for r in ready], *zip(*packed, strict=True)]
            ready, waiting = [], 0
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["piece", "nth", "n_docs", "n_tokens", "frame"])

        for batch in slices(batches, "text", 4 << 20):
            encoded = tokenizer.encode_all([text or "" for text in batch.column("text").to_pylist()])
            for id_, of, own in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist(), encoded, strict=True):
                if of != piece:
                    close()
                    piece, nth = of, 0
                ids = np.concatenate([own, tail])
                if size and size + len(ids) > FRAME:
                    close()
                names.append(id_)
                parts.append(ids)
                size += len(ids)
                if waiting >= LANES * BLOCK:
                    yield flush()
        close()
        if ready:
            yield flush()

    rows.select("id", "text", "piece").mapInArrow(tidy(run), "piece int, nth bigint, n_docs bigint, n_tokens bigint, frame binary").write.parquet(path)


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and on request ids, of every document of the files at ``path``.

    start counts the ids of all documents before. Damaged blocks raise an error. Frames are decoded where they lie; the
    starts come from sums over frames, then over pieces.
    """
    frames = spark.read.parquet(path)
    by_piece = frames.groupBy("piece").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    pieces = by_piece.select(F.col("piece").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("piece_start"))
    inside = Window.partitionBy("piece").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = frames.select("piece", "nth", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("frame_start"))
    starts = starts.join(pieces, F.col("piece") == F.col("p")).select("piece", "nth", (F.col("piece_start") + F.col("frame_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "frame", 4 << 20):
            rows: list[tuple] = []
            for piece, nth, found in zip(batch.column("piece").to_pylist(), batch.column("nth").to_pylist(), unpack(batch.column("frame").to_pylist()), strict=True):
                at = 0
                for name, ids in found:
                    rows.append((piece, nth, name, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                    at += len(ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["piece", "nth", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    docs = frames.select("piece", "nth", "frame").mapInArrow(tidy(run), "piece int, nth bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
    out = docs.join(starts, ["piece", "nth"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocabulary, end_id, id_col, text_col)
    return read(spark, path)
