"""Shared helpers: shared-folder tables, vectorised chunk hashing and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "docloom-checkpoints"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


#: Tables that this driver wrote into the shared folder; clear() deletes them.
_TABLES: list[str] = []


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends, lost executors lose nothing.

    A parquet table rather than checkpoint(): it is columnar and compressed, and computes df once. It lives
    until release() of this frame or clear(); results read it lazily, so clear() comes after they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _TABLES.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the table of a stored() frame that nothing reads any more."""
    _delete(df.sparkSession, df._stored_at)
    _TABLES.remove(df._stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all tables that stored() wrote in this session."""
    while _TABLES:
        _delete(spark, _TABLES.pop())


# ---------------------------------------------------------------- vectorised text chunks

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANES = 4
_LONG = 8 * _LANES
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _lanes(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, their bytes 8k to 8k + 7 as one word) for the chunks of more than 8k bytes, for each lane k."""
    padded = np.zeros(len(data) + _LONG, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + _LONG - 7, "<u8", padded, strides=(1,))
    out = []
    for k in range(_LANES):
        at = np.flatnonzero(n > 8 * k)
        out.append((at, words[starts[at] + 8 * k] & _MASK[np.minimum(n[at] - 8 * k, 8)]))
    return out


def hash_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[starts[i]:ends[i]]: mixed words of its bytes, XXH64 beyond 32 bytes."""
    from xxhash import xxh64_intdigest

    n = ends - starts
    h = mix(n.astype(np.uint64) * _STEP)
    for at, w in _lanes(data, starts, n):
        h[at] = mix((h[at] ^ w) + _STEP)
    long = np.flatnonzero(n > _LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = mix(h[long] ^ np.fromiter((xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long)))
    return h


def distinct_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a chunk of each kind, and the kind of each chunk; equal are only chunks of equal bytes.

    Chunks are sorted by a hash, then every chunk's bytes are held against those of its kind: up to 32 bytes
    as four words, longer ones by a dictionary of their bytes. Chunks that a hash confuses are sorted by bytes.
    """
    n = ends - starts
    lanes = _lanes(data, starts, n)
    ident = np.zeros(len(n), np.int64)
    long = np.flatnonzero(n > _LONG)
    if len(long):
        raw, known = np.ascontiguousarray(data), {}
        ident[long] = [known.setdefault(raw[a:b].tobytes(), len(known)) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    h = mix(n.astype(np.uint64) * _STEP ^ ident.astype(np.uint64))
    for at, w in lanes:
        h[at] = _fold(h[at], w)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    full = [n, ident]
    for at, w in lanes:
        lane = np.zeros(len(n), np.uint64)
        lane[at] = w
        full.append(lane)
    own = first[which]
    if not all((x == x[own]).all() for x in full):
        _, first, which = np.unique(np.stack([x.astype(np.uint64) for x in full], axis=1), axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
    return first, which


def _fold(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix((h ^ w) + _STEP)


# words: runs of ASCII letters and digits and non-ASCII bytes; A-Z count as a-z
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside` bytes; none runs over a row's end."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = inside[data]
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    rows = offsets[:-1]
    rows = rows[rows < len(data)]
    start[rows] = m[rows]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = m[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null is the empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, off, buf = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def trim() -> None:
    """Give memory that is free but still held by the allocators back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """(first row, end row) runs of rows of about `most` bytes; a longer single row is its own run."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i] .. starts[i]+lengths[i]-1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)


# ---------------------------------------------------------------- graphs

def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Parent of each of n rows after joining the pairs: the first row of its group."""
    parent = np.arange(n)
    for i, j in pairs:
        a, b = parent[i], parent[j]
        while (a != b).any():
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            a, b = parent[a], parent[b]
    return parent


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v), all held by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        pairs = np.concatenate([np.empty((2, 0), np.int64), *held], axis=1)
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        parent = forest(iter([(at[0], at[1])]), len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, partitions: int | None = None, held: int = 0) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b); ids are bigint.

    Alternating large-star and small-star steps: each is an aggregate and an equi-join, so a hub's rows are
    summed before they move and its join is one AQE can split. Every round is written to the shared folder.
    A round costs the driver some ten stages, whatever its size: once at most `held` distinct edges are left,
    at the beginning or after a round, one task joins them all and no round follows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e)
    before = None
    left = e.count() if held else 1
    while True:
        if left <= held:
            out = stored(_joined(e))
            release(e)
            return out
        # large star: every larger neighbour of u is joined to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are joined to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        release(old)  # e is a table of its own
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, left = now, now[0]
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
