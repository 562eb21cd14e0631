"""Sequence packing as a cutting-stock problem solved by column generation.

1. Each task tokenizes its texts, cuts documents at whole sequences, and gives every piece a size class and
   its rank within (class, task). Classes are exact up to 64 ids and then 32 to an octave, rounded up.
2. The histogram over the (at most 256) classes is all the driver sees: a linear program whose columns are
   patterns (class counts that fit one sequence). A knapsack dynamic program over the capacity prices new
   columns with the duals until none helps; patterns are rounded down and the rest packed first fit.
3. Ranks become global by adding class counts of earlier tasks, and the rank of a piece fixes its pattern,
   copy and slot by arithmetic on the pattern table (bounded by the classes, not by the data).

Edge rules: null and empty texts are the one id END; rows with null or repeated doc_id are packed as
documents of their own; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .chunks import ChunkCache, cut, gather
from .common import read, slices, stored, utf8_column

LENGTH = 4096
END = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- tokens

def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """Token ids of whole texts under a `tokenizers` file that lower-cases and splits words, by distinct chunks.

    Cuts are made at ASCII white space, around ASCII digits, and between letters and ASCII signs; letters are
    a-z, A-Z and the two-byte Latin-1 letters. Other non-ASCII bytes and apostrophes keep their neighbours.
    Texts with "<|" go to the library whole, as special tokens may stand in them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = np.full(256, 5)  # other bytes
        kind[[9, 10, 13, 32]] = 0
        kind[48:58] = 1
        kind[65:91] = kind[97:123] = 2
        signs = [b for b in range(33, 127) if not chr(b).isalnum() and b != 39]
        kind[signs] = 3
        kind[39] = 4
        a, b = np.meshgrid(kind, kind, indexing="ij")
        self.safe = (a == 0) ^ (b == 0) | ((a != b) | (a == 1)) & (a >= 1) & (a <= 3) & (b >= 1) & (b <= 3)
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.cache = ChunkCache(self._ids)

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for c in chunks:
            s = c.decode()
            if not c.strip(b" \t\n\r"):
                out.append(b"")
                continue
            if not all(ch.isalpha() and ch < "Ā" and ch not in "ªµº" for ch in s):
                out.append(np.array(self.library.encode(s, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            s = s.lower()
            ids = self.words.get(s)
            if ids is None:
                # one word of plain letters is one pre-token: the library's model takes its byte letters
                if len(self.words) > 300_000:
                    self.words.clear()
                letters = s if s.isascii() else "".join([self.letters[b] for b in s.encode()])
                ids = self.words[s] = np.array([t.id for t in self.library.model.tokenize(letters)], "<u4").tobytes()
            out.append(ids)
        return out

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets into them) of rows laid end to end."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        m = data.copy()
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]
        m[lead] = m[lead + 1] = 97
        starts = cut(data, offsets, self.safe, m)
        flat, n = gather(data, starts, self.cache, 4)
        ids = flat.reshape(-1).view("<u4")
        before = np.concatenate([[0], np.cumsum(n)])
        rows = before[np.searchsorted(starts, offsets)]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(special):
            parts = []
            odd = set(np.unique(np.searchsorted(offsets, special, "right") - 1).tolist())
            for r in range(len(offsets) - 1):
                if r in odd:
                    text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                    parts.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                else:
                    parts.append(ids[rows[r] : rows[r + 1]])
            rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, rows


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# ---------------------------------------------------------------- size classes and patterns

def sizes(length: int = LENGTH) -> np.ndarray:
    """Upper ends of the size classes: exact up to 64, then 32 to an octave."""
    out, step = list(range(1, min(64, length) + 1)), 2
    while out[-1] < length:
        top = min(2 * out[-1], length)
        out += list(range(out[-1] + step, top + 1, step))
        step *= 2
        if out[-1] != top:
            out.append(top)
    return np.array(out)


def _knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity with unlimited items, and the item last taken (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(size, c, "right"))
        best[c], took[c] = best[c - 1], -1
        if k:
            v = best[c - size[:k]] + value[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], i
    return best, took


def patterns(histogram: np.ndarray, size: np.ndarray, capacity: int, rounds: int = 120, tolerance: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """(counts a class, copies) that hold exactly the histogram, by column generation.

    The master program covers the demand with patterns at least cost, by revised simplex from the patterns
    of one class each. Pricing stops when the best pattern gains less than `tolerance`, which bounds the
    loss against the best cover of the rounded sizes, or after `rounds` knapsack passes.
    """
    used = np.flatnonzero(histogram)
    if not len(used):
        return []
    size, demand = size[used], histogram[used].astype(float)
    m = len(used)
    basis = np.diag(capacity // size).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    x = demand * np.diag(inverse)
    pool = np.empty((m, 0))
    for _ in range(rounds):
        dual = np.maximum(inverse.sum(0), 0)
        best, took = _knapsack(dual, size, capacity)
        if best[capacity] <= 1 + tolerance:
            break
        new = []
        for last in np.argsort(-(dual + best[capacity - size]))[:48].tolist():  # the best pattern that holds each of the most valued classes
            col, c = np.zeros(m), int(capacity - size[last])
            col[last] += 1
            while c > 0:
                if took[c] >= 0:
                    col[took[c]] += 1
                    c -= int(size[took[c]])
                else:
                    c -= 1
            new.append(col)
        pool = np.unique(np.concatenate([pool, np.array(new).T], axis=1), axis=1)
        good = basis.copy()
        for _ in range(40 * m):
            dual = inverse.sum(0)
            gain = dual @ pool - 1
            j = int(gain.argmax())
            if gain[j] <= tolerance / 2:
                break
            direction = inverse @ pool[:, j]
            up = direction > 1e-7
            if not up.any():
                break
            ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
            r = int(np.where(ratio <= ratio.min() + 1e-9, direction, -1).argmax())  # of ties the safest pivot
            x = x - ratio[r] * direction
            x[r] = ratio[r]
            x = np.maximum(x, 0)
            row = inverse[r] / direction[r]
            inverse = inverse - np.outer(direction, row)
            inverse[r] = row
            basis[:, r] = pool[:, j]
        try:
            fresh = np.linalg.inv(basis)
            spoilt = np.abs(basis @ fresh - np.eye(m)).max() > 1e-6
        except np.linalg.LinAlgError:
            spoilt = True
        if spoilt:  # by rounding: the last round's patterns stay
            basis = good
            x = np.maximum(np.linalg.solve(basis, demand), 0)
            break
        inverse = fresh
        x = np.maximum(inverse @ demand, 0)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []

    def take(counts: np.ndarray, copies: int) -> None:
        full = np.zeros(len(histogram), np.int64)
        full[used] = counts
        out.append((full, copies))
        left[used] -= counts * copies

    for r in np.argsort(-x).tolist():
        counts = np.round(basis[:, r]).astype(np.int64)
        has = counts > 0
        copies = min(int(x[r] + 1e-9), int((left[used][has] // counts[has]).min())) if has.any() else 0
        if copies:
            take(counts, copies)
    # what rounding left: first fit, largest first; each step takes all the copies it can
    while left.any():
        counts, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            counts[i] = min(left[used[i]], room // size[i])
            room -= counts[i] * size[i]
        has = counts > 0
        take(counts, max(1, int((left[used][has] // counts[has]).min())))
    return out


# ---------------------------------------------------------------- packing

PIECES = "part int, row bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, rank bigint"


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Every piece of every document, with its class and its rank among the task's pieces of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        tok, part, size = tokenizer(path), TaskContext.get().partitionId(), sizes(length)
        seen = np.zeros(len(size), np.int64)
        row = 0
        for b in batches:
            data, offsets = utf8_column(b.column(1))
            for i, j in slices(offsets):
                o = offsets[i : j + 1] - offsets[i]
                ids, at = tok.of(data[offsets[i] : offsets[j]], o)
                n = np.diff(at) + 1
                count = -(-n // length)
                doc = np.repeat(np.arange(j - i), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
                take = np.minimum(length, n[doc] - start)
                raw = np.insert(ids, at[1:], END).astype("<u4").tobytes()
                begin = (at[:-1] + np.arange(j - i))[doc] + start
                crc = [crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + take).tolist())]
                cls = np.searchsorted(size, take)
                order = np.argsort(cls, kind="stable")
                s = cls[order]
                new = np.concatenate([[True], s[1:] != s[:-1]])
                first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - first + seen[s]
                seen += np.bincount(cls, minlength=len(size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), pa.array(row + doc), b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(take), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(cls.astype(np.int32)), pa.array(rank)],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )
                row += j - i

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequence_id and offset in it."""
    spark = docs.sparkSession
    size = sizes(length)
    cut_up = stored(pieces(docs, path or default_tokenizer(), length))
    counts = cut_up.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).select("class", "part", "before")
    histogram = np.zeros(len(size), np.int64)
    for r in cut_up.groupBy("class").agg(F.count("*").alias("n")).collect():  # at most 256 rows
        histogram[r["class"]] = r["n"]
    # for each class: where its pieces go, by rank; a pattern's copies are consecutive sequences
    plan, sequence, given = [], 0, np.zeros(len(size), np.int64)
    for counts_, copies in patterns(histogram, size, length):
        for c in np.flatnonzero(counts_).tolist():
            each = int(counts_[c])
            plan.append((c, int(given[c]), each, sequence))
            given[c] += each * copies
        sequence += copies
    by_class: dict[int, list] = {}
    for c, first, each, s in plan:
        by_class.setdefault(c, []).append((first, each, s))
    schema = T.StructType([T.StructField("class", T.IntegerType()), T.StructField("plan", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "each", "seq")])))])
    table = spark.createDataFrame(list(by_class.items()), schema)  # at most 256 rows, patterns bounded by the classes
    placed = cut_up.join(counts, ["class", "part"]).join(F.broadcast(table), "class")
    placed = placed.withColumn("rank", F.col("rank") + F.col("before"))
    step = F.element_at(F.filter("plan", lambda p: p["first"] <= F.col("rank")), -1)
    placed = placed.withColumn("step", step).withColumn("within", F.col("rank") - F.col("step.first"))
    placed = placed.withColumn("sequence_id", F.col("step.seq") + F.floor(F.col("within") / F.col("step.each")))
    # at most `length` pieces stand in a sequence
    w = Window.partitionBy("sequence_id").orderBy("class", "rank")
    offset = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "class", "rank").withColumn("offset", offset).drop("class", "rank")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
