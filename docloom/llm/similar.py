"""Near-duplicates by word shingles: documents linked at a Jaccard similarity of at least SIMILARITY.

A document is the set of its runs of SHINGLE words (split at ASCII white space, A-Z in lower case); one of fewer
words is a single run. Equal sets are folded first, so a group of exact copies is one row before anything is
compared. Candidates share one of BANDS keys of ROWS minimum hashes each: a pair of similarity 0.8 meets in none
with a chance of 3e-6, a more similar one with less. Candidates are screened by SimHash: fingerprints of 256 bits
over the same sets, at most RADIUS bits apart. A pair of similarity 0.8 differs in 39 bits on average (48 in the
worst case, sets of 4 and 5 runs), five standard deviations below RADIUS. What passes is verified on the whole
sets, exactly. Blocks of the fingerprint cannot draw the candidates themselves: a block long enough to select
among many documents (30 bits) is shared by a pair of similarity 0.8 with a chance of 0.7 %.

In each bucket all rows are verified against its least one. Then, of a bucket whose other rows are still in
different components, all those of different components are compared: their sets, cut into parts of bounded size,
meet in one task, which compares their fingerprints bit-sliced, verifies what is near, and emits a forest of the
links it finds and never the pairs; buckets of the same rows are
compared once. So the components are those of all similar candidate pairs, also in a large group of near copies
of which many are just not similar.

Rows are told apart by a number of their own, so of one doc_id with several texts each is judged by its text.
A set is named by 128 bits of its hashes; words, and so shingles, are compared by 64-bit hashes.

Edge rules: null, empty and blank texts are one empty set, alike; rows with a null doc_id are not compared and
stay; repeated rows are copies of each other; an empty table gives no rows; a text may be longer than a slice
and is then one of its own; other columns are ignored and kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import simhash
from .common import LOWER, components, forest, hash_chunks, mix, ragged, slices, stored, utf8_column, word_spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
#: Bits of 256 within which a pair is verified.
RADIUS = 80
#: Fingerprints compared with all others of a group at a time.
TILE = 64
#: Shingles and rows of a bucket's part, about; parts meet in pairs.
PART, PART_ROWS = 1 << 20, 8192
#: Links that one task joins to components (about 100 bytes each); more are joined in rounds over all tasks.
HELD = 1 << 19

_SEEN = np.ones(256, bool)
_SEEN[[9, 10, 11, 12, 13, 32]] = False
_RNG = np.random.default_rng(20240818)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): sorted distinct shingle hashes of each text of a slice; text i has hashes[starts[i]:starts[i + 1]]."""
    n = len(offsets) - 1
    low = LOWER[data]
    at, ends = word_spans(low, offsets, _SEEN)
    w = hash_chunks(low, at, ends)
    bound = np.searchsorted(at, offsets)
    count = np.diff(bound)
    runs = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), runs)
    start = ragged(bound[:-1], runs)
    length = np.minimum(count, SHINGLE)[owner]
    h = length.astype(np.uint64) * _STEP
    for k in range(SHINGLE):
        inside = length > k
        h[inside] += mix(w[start[inside] + k] * _PLACE[k])
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def _each(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, starts) of slices of a batch whose last column is the text."""
    data, off = utf8_column(b.columns[-1])
    for i, j in slices(off):
        yield i, j, *shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _name(h: np.ndarray, at: np.ndarray, turn: int) -> pa.Array:
    """A 64-bit name of each set: its hashes turned, mixed and added up."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h * _TURN[turn] + _STEP), dtype=np.uint64)])
    return pa.array(np.where(np.diff(at) > 0, mix(total[at[1:]] - total[at[:-1]]), np.uint64(0)).view(np.int64))


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of words as lists of signed numbers."""
    where = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(where, pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, other, n, bands, print, doc): the rows of docs, each with its number, the name and size of
    its shingle set, its bucket keys and its fingerprint; doc holds the row as it was. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, at in _each(b):
                full = np.flatnonzero(np.diff(at))
                bands = np.zeros((j - i, BANDS), np.uint64)
                for k in range(BANDS if len(full) else 0):
                    band = np.full(len(full), k + 1, np.uint64) * _STEP
                    for r in range(k * ROWS, k * ROWS + ROWS):
                        band = mix(band + np.minimum.reduceat(h * _TURN[r] + _SHIFT[r], at[full]))
                    bands[full, k] = band
                row, doc_id, doc, _ = b.slice(i, j - i).columns
                columns = [row, doc_id, _name(h, at, 0), _name(h, at, 1), pa.array(np.diff(at)), _lists(bands), _lists(simhash.wide_prints(h, at)), doc]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "key", "other", "n", "bands", "print", "doc"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    long = [StructField(c, LongType()) for c in ("row", "doc_id", "key", "other", "n")]
    return stored(rows.mapInArrow(run, StructType([*long, StructField("bands", ArrayType(LongType())), StructField("print", ArrayType(LongType())), StructField("doc", docs.schema)])))


def sets(texts: DataFrame) -> DataFrame:
    """(row, print, shingles) of texts(row, print, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, at in _each(b):
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:2], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["row", "print", "shingles"])

    return texts.mapInArrow(run, "row bigint, print array<bigint>, shingles array<bigint>")


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose sets, in found(row, shingles, ...), are similar.

    Sets are joined by sorting, whatever their size: broadcast ones would pass through the driver.
    """
    x, y = (found.select(F.col("row").alias(c), F.col("shingles").alias(s)).hint("merge") for c, s in (("a", "x"), ("b", "y")))
    both = pairs.join(y, "b").join(x, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(SIMILARITY) * (F.size("x") + F.size("y") - common)).select("a", "b")


def links(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between first rows of classes that make the same components as all similar candidate pairs do."""
    one = drawn.where("n > 0").select("row", "n", "bands").join(classes.select("row"), "row", "left_semi")
    rows = stored(one.select("row", "n", F.explode("bands").alias("band")))
    first = F.min(F.struct("row", "n")).alias("least")
    shared = stored(rows.groupBy("band").agg(first, F.max("row").alias("most")).where("least.row <> most").select("band", "least"))
    met = stored(rows.join(shared, "band").select("band", "row", "n", "least"))
    # every row that meets another one: its set is built once, for both comparisons
    texts = drawn.select("row", "print", F.col("doc.text").cast("string").alias("text")).hint("merge")
    found = stored(sets(texts.join(met.select("row").distinct(), "row", "left_semi")))
    pairs = met.where("row <> least.row").select(F.col("least.row").alias("a"), F.col("row").alias("b"), "n", F.col("least.n").alias("m")).distinct()
    # sets whose sizes or fingerprints differ too much cannot be similar; fingerprints are joined once a pair, not once a bucket
    x, y = (found.select(F.col("row").alias(c), F.col("print").alias(p)) for c, p in (("a", "first"), ("b", "print")))
    pairs = pairs.where(F.least("n", "m") >= F.lit(SIMILARITY) * F.greatest("n", "m")).join(y, "b").join(x, "a")
    apart = F.aggregate(F.zip_with("print", "first", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    star = stored(_verified(pairs.where(apart <= RADIUS).select("a", "b"), found))
    comp = components(star, held=HELD)
    # the least row of a bucket has met all others: they meet each other, once for all buckets of the same rows
    placed = stored(met.where("row <> least.row").join(comp, F.col("row") == comp["node"], "left").select("band", "row", "n", F.coalesce("component", "row").alias("comp")))
    size = placed.groupBy("band").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("all"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("row")).alias("name"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("other")
    )
    parts = F.ceil(F.greatest(F.col("all") / PART, F.col("rows") / PART_ROWS)).cast("bigint")
    mixed = stored(size.where("low <> high").groupBy("name", "other", "rows", "all").agg(F.min("band").alias("band")).select("band", parts.alias("parts")))
    left = stored(placed.join(mixed, "band").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))))
    # a pair of parts (low, high) is one group; a bucket of one part is the group (0, 0)
    groups = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.shiftleft(F.least(j, F.col("part")), 32).bitwiseOR(F.greatest(j, F.col("part"))))
    sent = left.select("band", F.explode(groups).alias("grp"), "part", "comp", "row").join(found.hint("merge"), "row").select("band", "grp", "part", "comp", "row", "print", "shingles")
    return star.unionByName(sent.repartition("band", "grp").sortWithinPartitions("band", "grp").mapInArrow(_compare, "a bigint, b bigint"))


def linked(ids: np.ndarray, at: np.ndarray, comp: np.ndarray, part: np.ndarray, alike: bool, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of similar sets of different components; set i holds the numbers ids[at[i]:at[i + 1]], each once.

    alike: all sets meet each other; else only those of different parts do. prints: the sets' fingerprints.
    """
    n = np.diff(at)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    planes = simhash.vertical(prints)
    for i in range(len(n)):
        if i % TILE == 0:
            near = simhash.within(planes, prints[i : i + TILE], RADIUS)[:, : len(n)]
        fits = near[i % TILE] & (comp != comp[i]) & (np.minimum(n, n[i]) >= SIMILARITY * np.maximum(n, n[i]))
        fits[: i + 1] = False
        if not alike:
            fits &= part != part[i]
        j = np.flatnonzero(fits)
        if len(j):
            mark[ids[at[i] : at[i + 1]]] = True
            common = np.add.reduceat(mark[ids[ragged(at[j], n[j])]], np.cumsum(n[j]) - n[j], dtype=np.int64)
            mark[ids[at[i] : at[i + 1]]] = False
            j = j[common >= SIMILARITY * (n[j] + n[i] - common)]
            if len(j):
                yield np.full(len(j), i), j


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, grp, part, comp, row, print, shingles) sorted by (band, grp): forests of the groups' links."""
    held: list[pa.Table] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        part, comp, row = (t.column(c).to_numpy() for c in ("part", "comp", "row"))
        shingles = t.column("shingles").combine_chunks()
        at = np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())]).astype(np.int64)
        _, ids = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
        grp = int(t.column("grp")[0].as_py())
        prints = t.column("print").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(row), -1)
        parent = forest(linked(ids, at, comp, part, grp >> 32 == grp & 0xFFFFFFFF, prints), len(row))
        i = np.flatnonzero(parent != np.arange(len(row)))
        return pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(row[parent[i]])], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        ends = [(held[0].column("band")[0], held[0].column("grp")[0]), (b.column(0)[-1], b.column(1)[-1])]
        if ends[0] != ends[1]:
            t = pa.concat_tables(held)
            band, grp = t.column("band").to_numpy(), t.column("grp").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (grp[1:] != grp[:-1])) + 1]).tolist()
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield done(t.slice(s, e - s))
            held = [t.slice(cuts[-1])]
    if held:
        yield done(pa.concat_tables(held))


def _placed(drawn: DataFrame) -> DataFrame:
    """(row, doc_id, first: struct(doc_id, row) of the component's least) of the rows with a doc_id."""
    drawn = drawn.where("doc_id is not null")
    least = F.min(F.struct("doc_id", "row")).alias("least")
    classes = stored(drawn.groupBy("key", "other", "n").agg(least).withColumn("row", F.col("least.row")))
    comp = components(links(drawn, classes), held=HELD)
    named = classes.join(comp, classes["row"] == comp["node"], "left").select("key", "other", "n", "least", F.coalesce("component", "row").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    ids = named.join(first, "component").select("key", "other", "n", "first")
    return drawn.select("row", "doc_id", "key", "other", "n").join(ids, ["key", "other", "n"]).select("row", "doc_id", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs(doc_id, text) with a doc_id."""
    return _placed(sketches(docs.select("doc_id", "text"))).select("doc_id", F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least doc_id; all columns stay, and rows with a null doc_id do."""
    drawn = sketches(docs)
    gone = _placed(drawn).where("row <> first.row").select(F.col("row").alias("gone"))
    kept = drawn.select("row", "doc").hint("merge").join(gone, drawn["row"] == gone["gone"], "left_anti")
    return kept.select("doc.*")
