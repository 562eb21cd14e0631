"""SimHash near-duplicates: 64-bit fingerprints, linked at a Hamming distance of at most RADIUS.

Candidates: the bits are cut into BLOCKS blocks; two fingerprints within RADIUS bits agree on at least
BLOCKS - RADIUS of them, so every link meets in the bucket of some pair of whole blocks (exact, no miss).
Equal fingerprints are folded first, so a group of exact copies is one row before anything is compared.
A bucket of more than BUCKET fingerprints is cut into parts and every pair of parts is one group of work.

Comparison inside buckets is bit-sliced: bit b of all fingerprints is one packed plane; for the pairs
(i, i + d) the planes are XORed 8 pairs to a byte, differences are added in a carry-save counter of two
bit planes plus an overflow plane, and bytes whose pairs have all passed the radius are abandoned.

Edge rules: null or empty text has fingerprint zero, linked like any other; rows with a null doc_id get a
fingerprint and the component of their links, but never name a component (with no other row: null);
repeated rows are linked through their equal fingerprints; an empty table gives no rows; very long texts are
read whole, 65,536 shingles at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, mix, read, stored, utf8_column

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 5
BUCKET = 8192
#: Bits of the fingerprints that screen pairs for a similarity of shingles.
WIDE = 256
_WORDS = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_CUTS = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def fingerprint(text: bytes) -> int:
    """Fingerprint of UTF-8 text: majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not w:
        return 0
    if len(w) <= SHINGLE:
        return xxh64_intdigest(b" ".join(w), SEED)
    s = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    at = np.concatenate([[0], np.cumsum(size)])
    n = len(w) - SHINGLE + 1
    h = np.fromiter([xxh64_intdigest(s[a:b], SEED) for a, b in zip(at[:n].tolist(), (at[SHINGLE:] - 1).tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def wide_prints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WIDE-bit fingerprints of sets of 64-bit hashes, set i being h[at[i]:at[i + 1]]: a row of words a set, zero if empty.

    Sixteen-bit lanes of a word count four bits at a time, so a set is summed in runs of at most 65,535 hashes.
    """
    n = np.diff(at)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), WIDE // 64), np.uint64)
    if not len(full):
        return out
    runs = -(-n[full] // 65535)
    first = np.cumsum(runs) - runs
    starts = np.repeat(at[full], runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * 65535
    lane = np.uint64(0x0001000100010001)
    for k in range(WIDE // 64):
        g = mix(h ^ _WORDS[k])
        ones = np.empty((len(full), 64), np.int64)
        for j in range(16):
            total = np.add.reduceat((g >> np.uint64(j)) & lane, starts)
            for q in range(4):
                part = (total >> np.uint64(16 * q)) & np.uint64(0xFFFF)
                ones[:, 16 * q + j] = np.add.reduceat(part.astype(np.int64), first)
        out[full, k] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def vertical(prints: np.ndarray) -> np.ndarray:
    """Bit planes of prints: row b holds bit b of all of them, 64 to a word."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((-len(prints) % 64, bits.shape[1]), np.uint8)])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Whether each query print differs from each print of the planes in at most `radius` bits (padding included).

    Distances of 64 prints a word are added up by carry-save adders in counters set so that they overflow beyond
    the radius; a word whose prints have all overflowed is abandoned.
    """
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    width, words = planes.shape
    flip = np.where(np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little"), ones, np.uint64(0))
    who, where = np.divmod(np.arange(len(queries) * words), words)
    levels = radius.bit_length()
    preset = (1 << levels) - 1 - radius
    sums = [np.full(len(who), ones if preset >> k & 1 else 0, np.uint64) for k in range(levels)]
    waiting: list[np.ndarray | None] = [None] * levels
    over = np.zeros(len(who), np.uint64)

    def add(x: np.ndarray, k: int) -> None:
        while k < levels and waiting[k] is not None:
            y, waiting[k] = waiting[k], None
            half = sums[k] ^ x
            x, sums[k] = (sums[k] & x) | (half & y), half ^ y
            k += 1
        if k < levels:
            waiting[k] = x
        else:
            np.bitwise_or(over, x, out=over)

    for b in range(width):
        add(planes[b, where] ^ flip[who, b], 0)
        if b % 32 == 31 and b > radius:
            live = over != ones
            if not live.all():
                who, where, over = who[live], where[live], over[live]
                sums = [x[live] for x in sums]
                waiting[:] = [None if x is None else x[live] for x in waiting]
    for k in range(levels):
        if waiting[k] is not None:
            add(np.zeros(len(who), np.uint64), k)
    out = np.zeros((len(queries), words), np.uint64)
    out[who, where] = ~over
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little").astype(bool)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text); fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8_column(b.column(1))
            raw = memoryview(data)
            fp = np.fromiter((fingerprint(bytes(raw[i:j])) for i, j in zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _keys(fp):
    """Array of bucket keys of a fingerprint column: number of the block pair in the top bits."""
    out = []
    for k, pair in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        key = F.lit(k).cast("bigint")
        for b in pair:
            width = _CUTS[b + 1] - _CUTS[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, _CUTS[b]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        out.append(key)
    return F.array(*out)


def _close(fp: np.ndarray, last: np.ndarray, other: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, i + d) within the radius, for d = 1, 2, ...; i + d stays below last[i].

    other: part of the row; where the parts in a group differ, only pairs of different parts count.
    """
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T  # 64 planes of n bits
    pad = np.zeros((64, 80), np.uint8)
    bits = np.concatenate([bits, pad], axis=1)
    planes = [np.ascontiguousarray(np.packbits(bits[:, r:], axis=1, bitorder="little")) for r in range(8)]
    size = (n + 7) // 8
    reach = last - np.arange(n)
    for d in range(1, int(reach.max(initial=1))):
        active = reach > d
        active[: n - d] &= other[: n - d] != other[d:n]
        mask = np.packbits(active, bitorder="little")
        at = np.flatnonzero(mask[:size])
        if not len(at):
            continue
        mine, theirs, shift = planes[0], planes[d % 8], d // 8
        one = np.zeros(len(at), np.uint8)
        two, over, live = one.copy(), one.copy(), mask[at]
        for b in range(64):
            x = mine[b, at] ^ theirs[b, at + shift]
            carry = one & x
            one ^= x
            full = two & carry
            two ^= carry
            over |= full
            if b % 8 == 7 and b < 63:  # four or more differences everywhere: the block is abandoned
                keep = (live & ~over) != 0
                if not keep.all():
                    at, one, two, over, live = at[keep], one[keep], two[keep], over[keep], live[keep]
                    if not len(at):
                        break
        if len(at):
            near = np.unpackbits((live & ~over)[:, None], axis=1, bitorder="little")
            i = (at[:, None] * 8 + np.arange(8))[near.astype(bool)]
            if radius < 3:
                x = fp[i] ^ fp[i + d]
                i = i[np.bitwise_count(x) <= radius]
            if len(i):
                yield i, i + d


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each bucket; rows come sorted by (key, part pair)."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> pa.RecordBatch:
        key, group, part, fp = rows
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
        last = np.repeat(np.append(new[1:], len(key)), np.diff(np.append(new, len(key))))
        # an uncut bucket, and a part met with itself, compares all its rows: their parts are made different
        alike = (group >> 32) == (group & 0xFFFFFFFF)
        other = np.where(alike, -1 - np.arange(len(key)), part)
        fp = fp.view(np.uint64)
        parent = forest(_close(fp, last, other, RADIUS), len(fp))
        i = np.flatnonzero(parent != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[parent[i]].view(np.int64))], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if held:
            rows = np.concatenate([*held, rows], axis=1)
            held = []
        key, group = rows[0], rows[1]
        change = np.flatnonzero((key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield done(rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield done(held[0])


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that make the same components as all links do."""
    keyed = classes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    # counted by an aggregate: a hot bucket is summed where its rows are, and cut before it moves
    count = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a pair of parts (low, high) is one group; a bucket of one part is the group (0, 0)
    keyed = keyed.join(count, "key").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("bigint")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    groups = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.shiftleft(F.least(j, F.col("part")), 32).bitwiseOR(F.greatest(j, F.col("part"))))
    split = keyed.select("key", F.explode(groups).alias("grp"), "part", "fp")
    return split.repartition("key", "grp").sortWithinPartitions("key", "grp").mapInArrow(_link, "a bigint, b bigint")


def _components(classes: DataFrame) -> DataFrame:
    """(fp, least, first) of classes(fp, least): first is the least over the fingerprint's component."""
    comp = components(links(classes.select("fp")))
    named = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return named.join(named.groupBy("component").agg(F.min("least").alias("first")), "component").select("fp", "least", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs(doc_id, text)."""
    prints = stored(fingerprints(docs))
    placed = _components(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return prints.join(placed, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least doc_id; all columns stay, and rows with a null doc_id do.

    Rows are told apart by a number of their own: of one doc_id with several texts each is judged by its text.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    named = rows.where("doc.doc_id is not null")
    prints = fingerprints(named.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))).withColumnRenamed("doc_id", "row")
    prints = stored(prints.join(named.select("row", F.col("doc.doc_id").cast("bigint").alias("doc_id")), "row"))
    placed = _components(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("least")))
    gone = prints.join(placed, "fp").where("row <> first.row").select(F.col("row").alias("gone"))
    return rows.join(gone, rows["row"] == gone["gone"], "left_anti").select("doc.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
