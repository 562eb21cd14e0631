"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

The index is kept in document-partitioned segments, one row for about SEGMENT_BYTES of text: the dictionary
of its terms (bytes, in order of their hash), posting offsets and term-major positions. A segment is built by
one task from its own rows, so neither building nor searching shuffles text, and a document of any popularity
stays one document. The index is a table in the shared folder: a lost executor re-reads it, and several query
sets can reuse it.

A search takes each window's rarest term in the segment, adjusts its postings by the term's offset and
intersects them with the adjusted lists of the window's other terms, next rarest first. Terms are found by
their hash and confirmed by their bytes, so a match is exact. Benchmark text is broadcast in pieces of
PIECE_BYTES; a worker holds one piece at a time.

Edge rules: null and empty texts have no words; null benchmark ids or texts are no items; an empty benchmark
hits nothing, an empty table gives no rows; repeated document rows are judged one by one, also where one
doc_id has several texts; repeated benchmark rows with one item_id count as one item; columns besides doc_id
and text (item_id and text) are ignored, whatever their names. A text longer than a segment is a segment of
its own: positions are 32-bit, so one text may hold 4e9 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, distinct_chunks, hash_chunks, ragged, read, slices, stored, utf8_column, word_spans

WINDOW = 13
SEGMENT_BYTES = 4_000_000
#: Benchmark text is broadcast in pieces of at most this many bytes (or one item); any number of pieces is searched.
PIECE_BYTES = 2_000_000

INDEX_SCHEMA = "doc_ids array<bigint>, first_word array<int>, terms binary, term_ends binary, hashes binary, ends binary, positions binary"
_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("first_word", pa.list_(pa.int32())), *((n, pa.binary()) for n in ("terms", "term_ends", "hashes", "ends", "positions"))])


class Segment(NamedTuple):
    """Words before each document (and all); terms in order of hash: bytes, their ends; ends of postings; positions."""

    first: np.ndarray
    terms: bytes
    term_ends: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray
    positions: np.ndarray


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(term of each word, words before each row and in all, terms' bytes, their ends, their hashes), terms by hash."""
    low = LOWER[data]
    starts, ends = word_spans(low, offsets)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.int64), first, b"", np.empty(0, np.int64), np.empty(0, np.uint64)
    one, which = distinct_chunks(low, starts, ends)
    a, n = starts[one], ends[one] - starts[one]
    h = hash_chunks(low, a, a + n)
    order = np.argsort(h, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[which], first, low[ragged(a[order], n[order])].tobytes(), np.cumsum(n[order]), h[order]


def segment(data: np.ndarray, offsets: np.ndarray) -> Segment:
    term, first, terms, term_ends, h = _terms(data, offsets)
    # one position is left free after each document, so that no window runs over its end
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    position = (np.arange(len(term)) + doc).astype(np.uint32)
    ends = np.cumsum(np.bincount(term, minlength=len(h))).astype(np.uint32)
    return Segment(first, terms, term_ends, h, ends, position[np.argsort(term, kind="stable")])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of a positional inverted index over all words of docs(doc_id, text), in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8_column(b.column(1))
            for i, j in slices(offsets, SEGMENT_BYTES):
                o = offsets[i : j + 1]
                s = segment(data[o[0] : o[-1]], o - o[0])
                row = [b.column(0).slice(i, j - i).to_pylist(), s.first.astype(np.int32), s.terms, s.term_ends.astype(np.uint32).tobytes(), s.hashes.tobytes(), s.ends.tobytes(), s.positions.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX)], schema=_INDEX)

    return stored(_rows(docs).mapInArrow(build, INDEX_SCHEMA))


def phrases(items: list[tuple], window: int = WINDOW) -> dict:
    """The benchmark items' windows: term numbers (padded), number of terms, item; and the terms by hash."""
    texts = [t.encode() for _, t in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    term, first, blob, term_ends, h = _terms(np.frombuffer(b"".join(texts), np.uint8), offsets)
    rows, lens, item = [], [], []
    seen = set()
    for k, (name, _) in enumerate(items):
        w = term[first[k] : first[k + 1]]
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            x = w[s : s + n]
            if (key := (str(name), x.tobytes())) not in seen:
                seen.add(key)
                rows.append(np.pad(x, (0, window - n)))
                lens.append(n)
                item.append(str(name))
    texts = [blob[a:b] for a, b in zip([0, *term_ends.tolist()], term_ends.tolist())]
    return {"terms": np.array(rows, np.int64).reshape(-1, window), "n": np.array(lens, np.int64), "item": np.array(item, object), "hashes": h, "texts": texts}


def _lookup(seg: Segment, q: dict) -> np.ndarray:
    """Number of each phrase term in the segment, -1 where it has none: hashes are met, bytes confirm."""
    out = np.full(len(q["texts"]), -1)
    if not len(seg.hashes):
        return out
    low, high = np.searchsorted(seg.hashes, q["hashes"]), np.searchsorted(seg.hashes, q["hashes"], "right")
    for k in np.flatnonzero(low < high).tolist():
        for t in range(int(low[k]), int(high[k])):
            if seg.terms[int(seg.term_ends[t - 1]) if t else 0 : int(seg.term_ends[t])] == q["texts"][k]:
                out[k] = t
    return out


def find(seg: Segment, q: dict, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase number, document in the segment, position of the phrase's first word) of every match.

    With slop, every other term may lie up to slop words from its place beside the rarest term, inside the
    rarest term's document: proximity matches.
    """
    width = q["terms"].shape[1]
    known = _lookup(seg, q)
    inside = np.arange(width) < q["n"][:, None]
    at = known[q["terms"]] if len(known) else np.empty((0, width), np.int64)
    alive = np.flatnonzero(((at >= 0) | ~inside).all(1))
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at, inside = at[alive], inside[alive]
    stops = seg.ends.astype(np.int64)
    begins = np.concatenate([[0], stops[:-1]])
    df = np.where(inside, stops[at] - begins[at], np.iinfo(np.int64).max)
    by_rarity = np.argsort(df, axis=1, kind="stable")
    # term-major keys are sorted, as positions rise within a term
    span = np.int64(1) << 33
    used = np.unique(at[inside])
    counts = stops[used] - begins[used]
    keys = np.repeat(used * span, counts) + seg.positions[ragged(begins[used], counts)]
    docs = np.arange(len(seg.first) - 1)
    base, end = seg.first[:-1] + docs, seg.first[1:] + docs
    rows = np.arange(len(alive))
    rare = by_rarity[:, 0]
    n = df[rows, rare]
    phrase = np.repeat(rows, n)
    place = seg.positions[ragged(begins[at[rows, rare]], n)].astype(np.int64)
    doc = np.searchsorted(base, place, "right") - 1
    start = place - np.repeat(rare, n)
    for k in range(1, width):
        column = by_rarity[phrase, k]
        live = inside[phrase, column]
        term = at[phrase, column] * span
        least = np.maximum(start + column - slop, base[doc])
        most = np.minimum(start + column + slop, end[doc] - 1)
        near = keys[np.minimum(np.searchsorted(keys, term + least), len(keys) - 1)]
        keep = ~live | ((near >= term + least) & (near <= term + most))
        phrase, start, doc = phrase[keep], start[keep], doc[keep]
    return alive[phrase], doc, start


def _each(pieces: list) -> Iterator[dict]:
    """The broadcast pieces one after the other; only one is held by the worker."""
    for p in pieces:
        yield p.value
        if len(pieces) > 1 and hasattr(p, "_path"):
            p.__dict__.pop("_value", None)  # read again from the worker's copy when next asked for


def match(seg: Segment, pieces, window: int = WINDOW, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Of each document in the segment: words, words inside matched windows, whether a full window matched, items."""
    n = len(seg.first) - 1
    size = np.diff(seg.first)
    base = seg.first[:-1] + np.arange(n)
    cover, whole, found = np.zeros(int(seg.first[-1]) + n + 1, np.int64), np.zeros(n, bool), set()
    for q in pieces:
        p, d, s = find(seg, q, slop)
        np.add.at(cover, np.maximum(s, base[d]), 1)
        np.add.at(cover, np.minimum(s + q["n"][p], base[d] + size[d]), -1)
        whole[d[q["n"][p] == window]] = True
        pairs = np.unique(np.stack([d, p]), axis=1) if len(p) else np.empty((2, 0), np.int64)
        found.update(zip(pairs[0].tolist(), q["item"][pairs[1]].tolist()))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    items: list[list[str]] = [[] for _ in range(n)]
    for d, name in sorted(found):
        items[d].append(name)
    return size, hit[base + size] - hit[base], whole, items


def pieces_of(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id") -> list:
    """The benchmark's windows, broadcast in pieces of PIECE_BYTES; the driver holds one piece at a time."""
    context = benchmark.sparkSession.sparkContext
    pieces, now, size = [], [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        now.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= PIECE_BYTES:
            pieces.append(context.broadcast(phrases(now, window)))
            now, size = [], 0
    if now:
        pieces.append(context.broadcast(phrases(now, window)))
    return pieces


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item: str = "item_id") -> DataFrame:
    """One row per indexed document: words, words inside matched windows, and the items whose windows occur.

    Exact phrases with slop 0; with slop > 0, windows whose terms all lie within slop words of their places
    (of those, the windows' own places count as hit).
    """
    pieces = pieces_of(benchmark, window, item)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = {f: b.column(b.schema.get_field_index(f))[r] for f in b.schema.names}
                array = lambda name, kind: np.frombuffer(get[name].as_py(), kind)  # noqa: B023, E731
                seg = Segment(get["first_word"].values.to_numpy().astype(np.int64), get["terms"].as_py(), array("term_ends", np.uint32), array("hashes", np.uint64), array("ends", np.uint32), array("positions", np.uint32))
                n_words, n_hit, _, items = match(seg, _each(pieces), window, slop)
                yield pa.RecordBatch.from_arrays(
                    [get["doc_ids"].values, pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"]
                )

    return index.mapInArrow(look, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>")


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a benchmark passage; all columns stay.

    A row goes if a full window of an item occurs in it, however long its text is, or if windows of shorter
    items cover a twentieth of its words. Every row is judged by its own text. The postings serve once here,
    so a segment lives with its batch and neither texts nor decisions are shuffled.
    """
    pieces = pieces_of(benchmark, window)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8_column(b.column(at).cast(pa.string()))
            for i, j in slices(offsets, SEGMENT_BYTES):
                o = offsets[i : j + 1]
                n_words, n_hit, whole, _ = match(segment(data[o[0] : o[-1]], o - o[0]), _each(pieces), window)
                yield b.slice(i, j - i).filter(pa.array(~(whole | ((n_hit > 0) & (20 * n_hit >= n_words)))))

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.s, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(places.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(places.n_hit, 0) > 0 AND 20 * coalesce(places.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
