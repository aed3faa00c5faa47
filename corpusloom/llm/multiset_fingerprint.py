"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Every paragraph (line) is hashed to a wide vector: IDENTITY lanes of 64 bits from an extendable hash of the line, and
SKETCH lanes of 32 bits to which each run of up to three words of the line adds one or takes one off. A document's vector
is the sum over its paragraphs, lane by lane, modulo 2^64 and 2^32. So the order of paragraphs doesn't matter, and a
paragraph is put in or taken out by adding or subtracting its vector. Equal multisets have equal vectors; the sketch
lanes also tell how much two documents share, as the cosine of their signed sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import in_pieces, slices, tidy
from corpusloom.llm.recompress_core import BYTE_VALUES, mix, span_hashes, word_spans

IDENTITY, SKETCH, RUN = 16, 512, 3


@dataclass
class Vector:
    """The lanes of a multiset of paragraphs; + and - put in and take out those of another."""

    identity: np.ndarray
    sketch: np.ndarray

    def __add__(self, other: Vector) -> Vector:
        return Vector(self.identity + other.identity, self.sketch + other.sketch)

    def __sub__(self, other: Vector) -> Vector:
        return Vector(self.identity - other.identity, self.sketch - other.sketch)

    def to_bytes(self) -> bytes:
        return self.identity.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()

    def digest(self) -> str:
        return hashlib.blake2b(self.to_bytes(), digest_size=32).hexdigest()

    def likeness(self, other: Vector) -> float:
        """1 for equal vectors; else the cosine of the sketches, 0 where that is negative or one is empty."""
        if np.array_equal(self.identity, other.identity) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        a, b = self.sketch.view(np.int32).astype(float), other.sketch.view(np.int32).astype(float)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def fingerprint(text: str | None) -> Vector:
    """The vector of a text's lines; a null text is empty: one empty line."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    identity = np.zeros(IDENTITY, np.uint64)
    lines = raw.split(b"\n")
    digests = b"".join([hashlib.shake_128(line).digest(8 * IDENTITY) for line in lines])
    identity = np.frombuffer(digests, "<u8").reshape(-1, IDENTITY).sum(0, dtype=np.uint64)
    sketch = np.zeros(SKETCH, np.uint32)
    data, starts, ends = word_spans(raw)
    if len(starts):
        words = span_hashes(BYTE_VALUES[data], starts, ends)
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        last = np.searchsorted(line, line, "right")  # one past the line's last word
        at = np.arange(len(words))
        features = mix(span_hashes(words, at, np.minimum(at + RUN, last)))
        sign = np.where(features >> np.uint64(63), 1.0, -1.0)
        sums = np.bincount((features % np.uint64(SKETCH)).astype(np.int64), sign, SKETCH)
        sketch = sums.astype(np.int64).astype(np.uint32)
    return Vector(identity, sketch)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, vector) for every row; each is judged by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [fingerprint(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([v.digest() for v in found], pa.string()), pa.array([v.to_bytes() for v in found], pa.binary())], names=[id_col, "n_chars", "fingerprint", "vector"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"{id_col} {kind}, n_chars bigint, fingerprint string, vector binary")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next row is the one with the next smaller id, after the smallest the largest; rows that repeat an id stand in the
    order of their texts, null first; a null id comes last of all. A single row is its own next. A null text is empty.

    Rows go to ranges of ids, sorted; with each range goes a copy of the first row of the next one. The ranges' borders
    are quantiles of the ids, so the driver holds a number for each range. Texts are shuffled once.
    """
    spark = docs.sparkSession
    base, pieces = in_pieces(docs, id_col, text_col)
    heads = sorted((r["at"], r["piece"]) for r in base.groupBy("piece").agg(F.max("at").alias("at")).collect())
    # the first row of a piece follows the last of the next higher one, that of the highest the last of the lowest
    pairs = [(at, heads[(i + 1) % len(heads)][1]) for i, (at, _) in enumerate(heads)]
    to_piece = spark.createDataFrame(pairs, "head bigint, piece int")
    extra = base.drop("piece").join(F.broadcast(to_piece), F.col("at") == F.col("head")).select("id", "at", "text", "piece", F.lit(True).alias("extra"))
    rows = base.withColumn("extra", F.lit(False)).select("id", "at", "text", "piece", "extra").unionByName(extra)
    rows = rows.repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", "extra", F.desc("at"), F.col("text").asc_nulls_first())
    kind = base.schema["id"].dataType.simpleString()
    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (piece, id, text, vector) of the row that waits for its next
        for batch in slices(batches, "text"):
            id_type[:] = [batch.schema.field("id").type]
            out = []
            for id_, text, piece, is_extra in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "piece", "extra")), strict=True):
                if is_extra and (held is None or held[0] != piece):
                    continue  # only the first copy follows
                text = text or ""
                vector = fingerprint(text)
                if held is not None and held[0] == piece:
                    out.append(_row(held, text, vector))
                held = None if is_extra else (piece, id_, text, vector)
            if out:
                columns = list(zip(*out, strict=True))
                types = [id_type[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("id", "text", "piece", "extra").mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def _row(held: tuple, following: str, next_vector: Vector) -> tuple:
    _, id_, text, vector = held
    changed = edited(text, following)
    other = fingerprint(changed)
    return (id_, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), vector.digest(), other.digest(), round(vector.likeness(other), 6), round(vector.likeness(next_vector), 6))
