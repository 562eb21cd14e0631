"""Toxicity by class-conditional Kneser-Ney models of words.

Two interpolated Kneser-Ney models, one of labelled toxic and one of ordinary documents, give every word
its log-likelihood byte by byte between word borders. Their short orders are one shared table of pooled
continuation counts, so a rare expression that neither class knows backs off to the same numbers and says
little. A document is compared by its length-normalised log-likelihood difference: over all its words, and
in its most toxic run of RUN words (insults are local, documents long). A logistic calibration of these,
fitted on cross-fitted training documents, gives the score.

Labels are learned from at most SAMPLE documents of each class, those with the least hash of their id (a
bounded, documented sample); scoring reads every word of every text.

Edge rules: null and empty texts have no words and get the calibration's score for zero evidence; without
labelled rows of both classes the score is the toxic share of the labelled rows, 0 if there are none; null
labels or ids are not learned from; rows are scored one by one; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .chunks import ChunkCache
from .common import LOWER, WORD, distinct_chunks, read, slices, trim, utf8_column, word_spans

SAMPLE = 1200
ORDER = 9
SHARED = 2
DISCOUNT = 0.75
RUN = 2
#: Words a worker keeps the values of, and bytes of text it splits at a time: two workers share an executor's memory.
KEPT, SLICE = 500_000, 1_000_000

_RNG = np.random.default_rng(20240817)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, position in the word, and word of each byte; a word stands between a begin and an end mark."""
    flat = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in words]), np.uint8)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words), dtype=np.int32), n)
    at = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    return _BYTE_CODES[LOWER[flat]], at, word


def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of one more byte up to each position, of the hashes h."""
    out = codes.copy()
    out[1:] += h[:-1] * _STEP
    return out


class Table:
    """Counts of n-grams of one length, and totals and kinds of followers of their contexts, by hash."""

    def __init__(self, gram, context, count):
        self.gram, i = np.unique(gram, return_inverse=True)
        self.count = np.bincount(i, count, len(self.gram))
        context_of = np.empty(len(self.gram), np.uint64)
        context_of[i] = context
        self.context, j = np.unique(context_of, return_inverse=True)
        self.total = np.bincount(j, self.count, len(self.context))
        self.kinds = np.bincount(j, minlength=len(self.context)).astype(float)

    def interpolate(self, p, gram, context):
        if not len(self.gram):
            return p
        i = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        c = np.where(self.gram[i] == gram, self.count[i], 0.0)
        j = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        known = self.context[j] == context
        total = np.where(known, self.total[j], 1.0)
        return np.where(known, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * self.kinds[j] * p) / total, p)


class KneserNey:
    """Class-conditional models: tables[c][k] for orders above SHARED, shared[k] for the others."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        """counts[c, w]: documents of class c that hold word w."""
        codes, at, word = _positions(words)
        self.shared, self.tables = [], [[], []]
        before, now = np.zeros(len(codes), np.uint64), codes  # of k - 1 and k bytes
        for k in range(1, ORDER + 1):
            after = _longer(now, codes) if k < ORDER else None
            if k <= SHARED:
                self.shared.append(self._table(before, now, after, at, counts.sum(0)[word], k))
            else:
                for c in (0, 1):
                    self.tables[c].append(self._table(before, now, after, at, counts[c][word], k))
            before, now = now, after

    @staticmethod
    def _table(before, now, after, at, weight, k) -> Table:
        """n-grams of length k with Kneser-Ney counts: raw for the longest and at word begins, else kinds of left neighbours."""
        inner = np.flatnonzero((at >= k) & (weight > 0))  # a left neighbour (or begin mark) stands before
        if after is not None:
            inner = inner[np.unique(after[inner], return_index=True)[1]]
            inner_count = np.ones(len(inner))
        else:
            inner_count = weight[inner]
        opening = np.flatnonzero((at == k - 1) & (weight > 0) & (at > 0))  # the begin mark itself is never predicted
        p = np.concatenate([inner, opening])
        return Table(now[p], before[p - 1], np.concatenate([inner_count, weight[opening]]))

    def difference(self, words: list[bytes]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        return np.concatenate([np.empty(0), *[self._difference(words[i : i + 20000]) for i in range(0, len(words), 20000)]])

    def _difference(self, words: list[bytes]) -> np.ndarray:
        codes, at, word = _positions(words)
        inside = np.flatnonzero(at > 0)
        p = [np.full(len(inside), 1 / 256)]
        before, now = np.zeros(len(codes), np.uint64), codes
        for k in range(1, ORDER + 1):
            fits = at[inside] >= k - 1
            q = inside[fits]
            if k == SHARED + 1:
                p = [p[0], p[0].copy()]
            for c, pc in enumerate(p):
                table = self.shared[k - 1] if k <= SHARED else self.tables[c][k - SHARED - 1]
                pc[fits] = table.interpolate(pc[fits], now[q], before[q - 1])
            before, now = now, _longer(now, codes)
        return np.bincount(word[inside], np.log(p[1]) - np.log(p[0]), len(words))


def features(diff: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean difference, difference of the most toxic run, log length, of rows whose words start at first[i]."""
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(diff)])
    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    run = np.zeros(len(n))
    if len(diff):
        row = np.repeat(np.arange(len(n)), n)
        stop = np.minimum(np.arange(len(diff)) + RUN, first[1:][row])
        begin = np.maximum(np.minimum(np.arange(len(diff)), stop - RUN), first[:-1][row])
        value = (total[stop] - total[begin]) / RUN
        has = n > 0
        run[has] = np.maximum.reduceat(value, first[:-1][has])
    return np.stack([mean, run, np.log1p(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes last."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bags(rows: DataFrame) -> pd.DataFrame:
    """Words of the sample's documents in order, lower-cased; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8_column(b.column(1))
            low = LOWER[data]
            low = np.where(WORD[low], low, 32).astype(np.uint8).tobytes()
            texts = [b" ".join(low[i:j].split()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), b.column(2)], names=["h", "words", "toxic"])

    return rows.mapInArrow(run, "h bigint, words binary, toxic int").toPandas()


class Model:
    def __init__(self, kn: KneserNey | None, weights: np.ndarray, share: float):
        self.kn, self.weights, self.share = kn, weights, share
        self.cache = None

    def __getstate__(self):
        return {"kn": self.kn, "weights": self.weights, "share": self.share, "cache": None}

    def _values(self, words: list[bytes]) -> list[bytes]:
        d = self.kn.difference(words)
        return [v.tobytes() for v in d]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.kn is None:
            return np.full(len(offsets) - 1, self.share)
        if self.cache is None:
            self.cache = ChunkCache(self._values, KEPT)
        starts, ends = word_spans(data, offsets)
        first = np.searchsorted(starts, offsets)
        diff = np.empty(0)
        if len(starts):
            low = LOWER[data]
            one, which = distinct_chunks(low, starts, ends)
            raw = low.tobytes()
            values = self.cache.many([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
            diff = np.frombuffer(b"".join(values), np.float64)[which]
        x = np.c_[features(diff, first), np.ones(len(offsets) - 1)]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents of each class."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample rows of two numbers
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    got = _bags(rows.select(F.xxhash64("_id").alias("h"), F.coalesce("text", F.lit("")).alias("text"), "toxic")).sort_values(["h", "words"])
    y = got["toxic"].to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return Model(None, np.zeros(4), float(y.mean()) if len(y) else 0.0)
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int32) for t in got["words"]]
    words = list(vocabulary)
    del got, vocabulary

    def fit(pick: np.ndarray) -> KneserNey:
        counts = np.zeros((2, len(words)))
        for r in pick.tolist():
            counts[y[r], np.unique(ids[r])] += 1
        used = np.flatnonzero(counts.sum(0))
        return KneserNey([words[i] for i in used.tolist()], counts[:, used])

    fold = np.arange(len(y)) % 2
    # alternate folds within each class
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % 2
    x = np.zeros((len(y), 3))
    for f in (0, 1):
        if len(set(y[fold != f].tolist())) < 2:
            continue
        diff = fit(np.flatnonzero(fold != f)).difference(words)
        for r in np.flatnonzero(fold == f).tolist():
            x[r] = features(diff[ids[r]], np.array([0, len(ids[r])]))[0]
    return Model(fit(np.arange(len(y))), _logistic(x, y), float(y.mean()))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column for every whole text; all other columns stay, one named like the score is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = docs.columns
    at = order.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(shared.value, b.column(at)))], names=[*order, name])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(name, DoubleType()))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = utf8_column(column.cast(pa.string()))
    out = [model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, SLICE)]
    trim()
    return np.concatenate(out) if out else np.empty(0)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below 0.5; all columns stay, whatever their names. Every row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column(at)) < 0.5))

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = score(docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"))), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
