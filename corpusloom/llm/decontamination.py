"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment of words.

An alignment's score is the share of the item's own score; a pair counts from ``least`` on. How long a run of words an edited
copy keeps is not known: at a score of a half every other word may be new. So seeds are single words, the rarest of each
item by the number of documents that have them, as many as the score leaves no way around, and several of them must stand
close together. Only where they do is a passage aligned, and no pair that reaches the score is passed by.

Test items go to the executors in blocks of bounded size; every block counts its words over all documents and then meets
them all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import lean, slices, tidy

WORD = re.compile(r"\w+").findall
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of test items that go to the executors at once.
BLOCK_BYTES = 8 << 20
#: One seed of so many words of an item must be matched, close together. Hits of seeds that are held at once, about.
SEEDS_EACH, HITS = 6, 300_000


class Items:
    """A block of test items: ids of their words and, once the corpus has been counted, the rare words that seed an alignment.

    An alignment that scores ``least`` has at least ceil(m least) of an item's m words as matches. So of the item's
    m - ceil(m least) + j rarest words at least j are matched, and they lie within the m (3 - 2 least) words that such an
    alignment spans at most. ``j`` grows with the item; a passage with fewer of the seeds in that span can't reach the score.
    """

    def __init__(self, rows: list[tuple[object, str]], least: float):
        self.vocabulary: dict[str, int] = {}
        self.least = least
        by_words: dict[tuple[int, ...], list[object]] = {}
        for item, text in rows:
            words = WORD(text.lower())
            if words:
                by_words.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), []).append(item)
        # items of the same words are aligned once
        self.words = [np.array(w, np.int64) for w in by_words]
        self.ids = list(by_words.values())

    def choose(self, frequency: np.ndarray) -> Items:
        """Take each item's rarest words as seeds, by the number of documents that have them."""
        n = len(self.words)
        self.together, self.span = np.ones(n, np.int64), np.ones(n, np.int64)
        pairs: list[np.ndarray] = []
        for k, own in enumerate(self.words):
            m = len(own)
            need = max(1, math.ceil(m * self.least - 1e-9))
            self.together[k] = j = min(need, max(1, m // SEEDS_EACH))
            self.span[k] = int(m * (3 - 2 * self.least) + 1e-9) + 1
            rare = np.unique(own[np.lexsort((own, frequency[own]))[: m - need + j]])
            pairs.append(np.stack([rare, np.full(len(rare), k)]))
        word, item = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
        order = np.lexsort((item, word))
        self.seeded = item[order]
        self.degree = np.bincount(word, minlength=len(self.vocabulary) + 1)
        self.start = np.cumsum(self.degree) - self.degree
        return self

    def of_text(self, text: str | None) -> np.ndarray:
        """Word ids, 0 for a word that no item has."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in WORD(text.lower())], np.int64) if text else np.empty(0, np.int64)

    def passages(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, list[list[int]]]]:
        """(text, item, spans of words) that have enough of the item's seeds close together, texts in order."""
        i = 0
        while i < len(texts):
            end, hits = i + 1, int(self.degree[texts[i]].sum())
            while end < len(texts) and hits + (more := int(self.degree[texts[end]].sum())) <= HITS:
                hits, end = hits + more, end + 1
            # one text with very many hits is looked through for a part of the items at a time
            parts = max(1, -(-hits // HITS))
            for part in range(parts):
                yield from self._passages(texts[i:end], i, part, parts)
            i = end

    def _passages(self, texts: list[np.ndarray], first: int, part: int, parts: int) -> Iterator[tuple[int, int, list[list[int]]]]:
        words = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        place = np.arange(len(words)) - np.repeat(np.cumsum([0, *map(len, texts)])[:-1], [len(t) for t in texts])
        found = []
        for s in range(0, len(words), HITS):
            own = words[s : s + HITS]
            n = self.degree[own]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, row = self.seeded[np.repeat(self.start[own], n) + nth], np.repeat(np.arange(s, s + len(own)), n)
            found.append((item, row) if parts == 1 else (item[item % parts == part], row[item % parts == part]))
        item, row = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        key, at = text[row] * len(self.words) + item, place[row]
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        item = key % max(1, len(self.words))
        last = np.arange(len(key)) + self.together[item] - 1
        inside = last < len(key)
        last = np.minimum(last, len(key) - 1)
        close = np.flatnonzero(inside & (key[last] == key) & (at[last] - at < self.span[item])) if len(key) else np.empty(0, np.int64)
        begin, end = at[last[close]] + 1 - self.span[item[close]], at[close] + self.span[item[close]]
        current, spans = None, []
        for k, a, b in zip(key[close].tolist(), begin.tolist(), end.tolist(), strict=True):
            if k != current:
                if spans:
                    yield first + current // len(self.words), current % len(self.words), spans
                current, spans = k, []
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([max(0, a), b])
        if spans:
            yield first + current // len(self.words), current % len(self.words), spans

    @staticmethod
    def _can_reach(own: np.ndarray, passage: np.ndarray, known: np.ndarray, need: float) -> bool:
        """Whether the item's words in the passage allow the score, whatever their order.

        In an alignment every word of the passage is a match or costs one, so the best sum over a run of the passage bounds the
        score; and there are no more matches than words of the item that the passage has.
        """
        upto = np.concatenate([[0], np.cumsum(np.where(known[passage], MATCH, MISMATCH))])
        if (upto - np.minimum.accumulate(upto)).max() < MATCH * need:
            return False
        return np.isin(own, passage).sum() >= need

    def matches(self, texts: list[str | None]) -> list[tuple[int, object, float, int, int]]:
        """(text, item, score, first word, end word) of the best alignment of each text and item that reaches ``least``."""
        of = [self.of_text(t) for t in texts]
        out, known = [], np.zeros(len(self.vocabulary) + 1, bool)
        for text, item, spans in self.passages(of):
            own, words = self.words[item], of[text]
            need = len(own) * self.least - 1e-9
            known[own] = True
            spans = [(a, b) for a, b in ((a, min(b, len(words))) for a, b in spans) if self._can_reach(own, words[a:b], known, need)]
            known[own] = False
            if not spans:
                continue
            best = max(((*align(own, words[a:b]), a) for a, b in spans), key=lambda x: (x[0], -x[3]))
            score = best[0] / (MATCH * len(own))
            if score >= self.least:
                out += [(text, i, score, best[3] + best[1], best[3] + best[2]) for i in self.ids[item]]
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best local score, and where in the passage it starts and ends.

    A row of the table at a time; the gaps along a row are a running maximum. With every cell goes the start of its path.
    """
    m = len(passage)
    steps = -GAP * np.arange(m + 1, dtype=np.int64)
    before, start = np.zeros(m + 1, np.int64), np.arange(m + 1, dtype=np.int64)
    best, best_start, best_end = 0, 0, 0
    big = m + 2
    for w in item:
        diagonal = before[:-1] + np.where((passage == w) & (w > 0), MATCH, MISMATCH)
        up = before[1:] + GAP
        score, origin = np.zeros(m + 1, np.int64), np.arange(m + 1, dtype=np.int64)
        score[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin[1:] = np.where(score[1:] == 0, np.arange(1, m + 1), np.where(diagonal >= up, start[:-1], start[1:]))
        # of equal scores the latest start wins: both ride in one number
        packed = np.maximum.accumulate((score + steps) * big + origin)
        row = packed // big - steps
        start = np.where(row > 0, packed % big, np.arange(m + 1))
        before = np.maximum(row, 0)
        end = int(before.argmax())
        if before[end] > best:
            best, best_start, best_end = int(before[end]), int(start[end]), end
    return best, best_start, best_end


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The test items in blocks of about BLOCK_BYTES; one item alone may be larger."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", F.col("item")), F.lit(blocks)) == b).orderBy("item", "text").collect()
        if rows:
            yield [(r["item"], r["text"]) for r in rows]


def counted(docs: DataFrame, items: Items, text_col: str) -> np.ndarray:
    """How many rows of ``docs`` have each word of the items, by word id: a number for each word of a block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen = np.zeros(len(own.vocabulary) + 1, np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen[np.unique(own.of_text(text))] += 1
        word = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(seen[word])], names=["word", "n"])

    out = np.zeros(len(items.vocabulary) + 1, np.int64)
    rows = lean(docs).select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    for word, n in rows.collect():  # no more than the block has words
        out[word] = n
    return out


def prepared(docs: DataFrame, benchmark: DataFrame, least: float, text_col: str, item_col: str, item_text: str) -> Iterator[object]:
    """The blocks of items with their seeds chosen, as broadcasts of bounded size."""
    for rows in item_blocks(benchmark, item_col, item_text):
        items = Items(rows, least)
        if items.words:
            yield docs.sparkSession.sparkContext.broadcast(items.choose(counted(docs, items, text_col)))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): every document and test item whose alignment scores ``least`` or more.

    Words are ``\\w+`` in lower case. score is 1 for a whole copy; the span counts words of the document. Null and empty
    texts match nothing; items without words are left out. Repeated rows and items give a row each. Other columns are left
    out. Only counts of words are shuffled.
    """
    out = None
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, score double, start_word bigint, end_word bigint"
    for shared in prepared(docs, benchmark, least, text_col, item_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, "text"):
                found = items.matches(batch.column("text").to_pylist())
                if found:
                    row, item, score, start, end = zip(*found, strict=True)
                    ids = batch.column("id").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_type), pa.array([round(s, 6) for s in score]), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "score", "start_word", "end_word"])

        part = lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, text_col: str = "text", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that match no test item, with all their columns. Each row is judged by itself, so nothing is
    joined back; a null or empty text stays."""
    kept = docs
    for shared in prepared(docs, benchmark, least, text_col, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in items.matches(batch.column("text").to_pylist())]] = False
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(clean))], names=["row"])

        base = lean(kept).select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"))
        kept = base.mapInArrow(tidy(run), f"row {base.schema['row'].dataType.simpleString()}").select("row.*")
    return kept
