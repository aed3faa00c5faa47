"""Toxicity by a cumulative-link ordinal regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - theta_k): one weight vector for all thresholds theta_1 < theta_2 < theta_3. The weights
have an L1 penalty, so most features get none. The expected severity is the sum of the probabilities over the thresholds.

Features are the words of a text in lower case and the beginnings of its words, START[0] to START[-1] characters long,
which pool words that share a stem. A feature's value is log(1 + rate), with its rate in a hundred words of the text, so
that one chance hit in a long text counts for little, and of at most MOST, so that one word said over and over does not either.

The labels are 0 or 1, and no table holds degrees of severity. Grades are made from the labels by folds: 0 is not toxic;
a toxic text gets 1, 2 or 3 by the third of the toxic texts into which the log-odds fall that a model of two grades,
fitted without it, gives it. So a grade says how strongly a text resembles the other toxic ones, and nothing more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices, tidy
from corpusloom.llm.fingerprints import shingle_hashes

GRADES = 3
WORD = re.compile(r"\w+").findall
#: Lengths of the beginnings of words, what is added to a text's number of words before rates are taken, and the highest rate.
START, PRIOR, MOST = range(2, 9), 50.0, 10.0
#: Features that a model is fitted on at most: those whose shares in toxic and in clean texts differ most surely.
FEATURES = 20_000
#: Words whose features a worker remembers.
MEMO = 200_000


def parts_of(word: str) -> list[str]:
    """A word's features: ``<start`` for each beginning, ``<word>`` for the whole."""
    return [f"<{word[:n]}" for n in START if n <= len(word)] + [f"<{word}>"]


def rate(n: float, words: int) -> float:
    return float(np.log1p(min(100.0 * n / (words + PRIOR), MOST)))


@dataclass
class Model:
    """Weights by feature, thresholds, and the expected severity from which a text is rejected."""

    weights: dict[str, float]
    theta: tuple[float, ...]
    cut: float
    #: The weighted features of the words met so far.
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def score(self, text: str | None) -> float:
        """The weighted sum of a text's features; 0 without any."""
        words, weights, memo = WORD(text.lower()) if text else [], self.weights, self.memo
        found: Counter = Counter()
        for word, n in Counter(words).items():
            parts = memo.get(word)
            if parts is None:
                if len(memo) >= MEMO:
                    memo.clear()
                parts = memo[word] = tuple(p for p in parts_of(word) if p in weights)
            for p in parts:
                found[p] += n
        return sum(weights[p] * rate(n, len(words)) for p, n in sorted(found.items()))

    def severity(self, text: str | None) -> tuple[float, int]:
        """Expected severity and the most probable grade."""
        z = self.score(text)
        above = [1.0, *(1.0 / (1.0 + np.exp(np.clip(t - z, -40, 40))) for t in self.theta), 0.0]
        return float(sum(above[1:-1])), int(np.argmax([above[k] - above[k + 1] for k in range(len(above) - 1)]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, d: int, grade: np.ndarray, penalty: float, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient descent on the mean negative log-likelihood plus an L1 penalty on the weights."""
    k = np.arange(1, max(1, int(grade.max(initial=1))) + 1)
    reach = (grade[:, None] >= k).astype(float)
    theta = np.array([np.log((1 - p) / p) for p in np.clip(reach.mean(0), 1e-3, 1 - 1e-3)])
    theta = np.maximum.accumulate(theta + 1e-3 * k)
    # the gain of X'X by power steps gives the step size
    v = np.ones(d) / np.sqrt(max(d, 1))
    for _ in range(12):
        u = np.bincount(rows, values * v[cols], n)
        v = np.bincount(cols, values * u[rows], d)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    rate = 1.0 / (0.5 * size / n + 1e-9)
    w = y = np.zeros(d)
    t = 1.0
    for _ in range(steps):
        z = np.bincount(rows, values * y[cols], n)
        above = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - theta), np.zeros((n, 1))], 1)
        slope = above * (1 - above)
        at = np.arange(n)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        low, high = slope[at, grade] / p, slope[at, grade + 1] / p
        g = np.bincount(cols, values * ((high - low) / n)[rows], d)
        w_new = y - rate * g
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * penalty, 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = w_new + (t - 1) / t_new * (w_new - w)
        w, t = w_new, t_new
        theta = np.maximum.accumulate(theta - 2.0 * theta_slope(theta, z, grade)) + 1e-6 * k
    z = np.bincount(rows, values * w[cols], n)
    for _ in range(4 * steps):  # the weights stand; the thresholds alone are cheap to bring to their place
        theta = np.maximum.accumulate(theta - 4.0 * theta_slope(theta, z, grade)) + 1e-6 * k
    return w, theta


def theta_slope(theta: np.ndarray, z: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The mean negative log-likelihood's derivatives by the thresholds."""
    n, at = len(z), np.arange(len(z))
    above = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - theta), np.zeros((n, 1))], 1)
    slope = above * (1 - above)
    p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
    # p rises with the threshold above a grade and falls with the one that it has passed
    down = np.bincount(grade, slope[at, grade] / p, len(theta) + 1)[1:]
    up = np.bincount(grade, slope[at, grade + 1] / p, len(theta) + 1)[:-1]
    return (down - up) / n


def without_copies(texts: list[str | None]) -> list[int]:
    """The texts that don't share the least shingle hash of an eighth of all hashes with one before: else the words of a
    text with many near copies, all with one label, would pass for words of that label."""
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, 5)
        part = (hashes >> np.uint64(61)).astype(int)
        least = {int(hashes[part == p].min()) for p in range(8) if (part == p).any()}
        if not least & seen:
            out.append(i)
        seen |= least
    return out


def surest(hot: np.ndarray, all_: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How surely features differ in their share of toxic and clean texts, in standard deviations."""
    share = all_ / np.float32(n1 + n0)
    return np.abs(hot / np.float32(n1) - (all_ - hot) / np.float32(n0)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * np.float32(1 / n1 + 1 / n0))


def fit_texts(texts: list[str | None], toxic: list[int], penalty: float = 0.0007, folds: int = 2, least_df: int = 3) -> Model:
    """The model of labelled texts; the cut is the one with the best F1 on texts held out in turn. ``texts`` is emptied.

    Without a toxic and a clean text nothing can be learnt: no weights, and nothing is rejected.
    """
    first = without_copies(texts)
    own, y = [texts[i] for i in first], np.array([toxic[i] for i in first], int)
    texts.clear()
    if not len(y) or y.min() == y.max():
        return Model({}, tuple(float(5 + k) for k in range(GRADES)), float(GRADES + 1))
    n, n1 = len(y), int(y.sum())
    # the sample is held as numbers; counts by hash come first, so that rare and even features need no names
    seen, mask = np.zeros((2, 1 << 22), np.int16), (1 << 22) - 1
    for t, mark in zip(own, y.tolist(), strict=True):
        seen[mark][list({hash(p) & mask for w in set(WORD(t.lower()) if t else []) for p in parts_of(w)})] += 1
    open_ = np.zeros(1 << 22, bool)
    for at in range(0, 1 << 22, 1 << 18):
        cold, hot = seen[:, at : at + (1 << 18)].astype(np.float32)
        open_[at : at + (1 << 18)] = (cold + hot >= least_df) & (surest(hot, cold + hot, n1, n - n1) >= 1)
    del seen
    number: dict[str, int] = {}
    rows_, cols_, values_ = [], [], []
    for i in range(n):
        words, found = WORD(own[i].lower()) if own[i] else [], Counter()
        own[i] = None
        for word, times in Counter(words).items():
            for p in parts_of(word):
                if open_[hash(p) & mask]:
                    found[p] += times
        cols_.append(np.array([number.setdefault(p, len(number)) for p in found], np.int32))
        values_.append(np.log1p(np.minimum(100.0 * np.array(list(found.values()), np.float32) / np.float32(len(words) + PRIOR), np.float32(MOST))))
        rows_.append(np.full(len(found), i, np.int32))
    rows, cols, values = (np.concatenate(x) for x in (rows_, cols_, values_))
    del rows_, cols_, values_, open_
    names = list(number)
    del number

    def fitted(keep: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, thresholds) on the texts of ``keep``, over the features that differ most surely there."""
        inside = keep[rows]
        r, c, v = (np.cumsum(keep) - 1)[rows[inside]], cols[inside], values[inside]
        k1, k0 = max(1, int(y[keep].sum())), max(1, int((1 - y[keep]).sum()))
        all_, hot = np.bincount(c, minlength=len(names)), np.bincount(c[y[keep][r] == 1], minlength=len(names))
        sure = np.where(all_ >= least_df, surest(hot, all_, k1, k0), -1)
        best = np.flatnonzero(sure >= max(1.0, np.partition(sure, -FEATURES)[-FEATURES] if len(sure) > FEATURES else 0.0))
        place = np.full(len(names), -1, np.int64)
        place[best] = np.arange(len(best))
        sel = place[c] >= 0
        w, theta = fit_weights(r[sel], place[c[sel]], v[sel].astype(float), int(keep.sum()), len(best), grade[keep], penalty)
        whole = np.zeros(len(names))
        whole[best] = w
        return whole, theta

    fold = np.arange(n) % folds

    def out_of_fold(grade: np.ndarray, severity: bool) -> np.ndarray:
        """Each text's log-odds, or its expected severity, from a model fitted without its fold."""
        found = np.zeros(n)
        for f in range(folds):
            w, theta = fitted(fold != f, grade)
            z = np.bincount(rows, values * w[cols], n)
            found[fold == f] = (sigmoid(z[:, None] - theta).sum(1) if severity else z)[fold == f]
        return found

    z = out_of_fold(y, False)
    thirds = np.quantile(z[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (z > thirds[0]) + (z > thirds[1]), 0)
    held_out = out_of_fold(grade, True)
    order = np.argsort(-held_out, kind="stable")
    s = held_out[order]
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, n + 1) + n1)
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut between equal severities
    best = int(np.argmax(f1))
    cut = float((s[best] + s[best + 1]) / 2) if best + 1 < n else float(s[best])
    w, theta = fitted(np.ones(n, bool), grade)
    whole = Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, tuple(theta.tolist()), 0.0)
    # a text without any feature is never rejected
    whole.cut = max(cut, whole.severity(None)[0] + 1e-6)
    return whole


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, text, toxic) of labelled documents in the order of a hash of their id: at most ``sample_rows``, and of these as
    many as ``sample_bytes`` bytes of text hold. The first alone may be longer, cut nowhere."""
    some = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    found = lean(docs).select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(some), id_col)
    # an id that several rows have must not widen the sample; only sizes are ranked, at most sample_rows of them
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = found.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), t.alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct().orderBy("h", "id", "t").limit(sample_rows)
    held = sized.withColumn("sum", F.sum("size").over(Window.orderBy("h", "id", "t"))).where((F.col("sum") <= sample_bytes) | (F.col("sum") == F.col("size"))).select("id", "t")
    return found.join(F.broadcast(held), (F.col(id_col) == F.col("id")) & (t == F.col("t"))).groupBy("id", "t").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample_rows`` labelled documents with at most ``sample_bytes`` of text, those with the smallest hash
    of their id. Null labels and ids are left out; of an id's several labels the highest counts.

    The bounded sample meets in one task, which can be run again; the driver gets the weights alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("t", "id", "text", "toxic")), strict=True)]
        rows.sort(key=lambda r: (r[0], str(r[1])))
        model = fit_texts([r[2] for r in rows], [int(r[3] > 0) for r in rows])
        names = list(model.weights)
        lists = [(names, pa.string()), ([model.weights[n] for n in names], pa.float64()), (list(model.theta), pa.float64())]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(t)) for x, t in lists), pa.array([model.cut])], names=["names", "weights", "theta", "cut"])

    rows = sample(docs, labels, sample_rows, sample_bytes, id_col, text_col).repartition(1)
    found = rows.mapInArrow(tidy(run), "names array<string>, weights array<double>, theta array<double>, cut double").collect()
    if not found:  # an empty table has no task
        return fit_texts([], [])
    return Model(dict(zip(found[0]["names"], found[0]["weights"], strict=True)), tuple(found[0]["theta"]), found[0]["cut"])


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its ``columns`` (all, if not given) and expected_severity, grade and toxic (1 from the model's cut on).

    A null or empty text has no features: its severity is that of the thresholds alone, and it is not rejected. Columns named like the results
    are replaced. Rows are judged one by one on their whole text; nothing is shuffled.
    """
    spark = docs.sparkSession
    own = {"expected_severity", "grade", "toxic"}
    base = lean(docs).select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns if c not in own)).alias("row"))
    shared = spark.sparkContext.broadcast(model)  # at most a weight for each word of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            found = [m.severity(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([round(s, 6) for s, _ in found], pa.float64()), pa.array([g for _, g in found], pa.int32()), pa.array([int(s >= m.cut) for s, _ in found], pa.int32())],
                names=["row", "expected_severity", "grade", "toxic"],
            )

    return base.mapInArrow(tidy(run), f"row {base.schema['row'].dataType.simpleString()}, expected_severity double, grade int, toxic int").select("row.*", "expected_severity", "grade", "toxic")
