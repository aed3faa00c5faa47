"""SimHash fingerprints of word shingles, computed per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices, tidy

#: A-Z alone are lower-cased; a shingle's words are joined by one space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of bits that a byte can count, and shingle hashes whose bits are counted at once.
BYTE, CHUNK = 255, 255 << 8


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; of all words if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    # on bytes, split() takes the ASCII white space alone
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))  # one past the space after each word
    hashes = [xxh64_intdigest(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])]  # noqa: B905
    return np.array(hashes, np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        full = len(bits) // BYTE * BYTE  # eight counters of a byte each add up in one word
        for part in ([bits[:full].reshape(-1, BYTE, 8).sum(1)] if full else []) + [bits[full:].sum(0, keepdims=True)]:
            ones += np.ascontiguousarray(part).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed 64-bit integer. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [simhash(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")
