"""Inverted index, BM25, dense search, fusion, intent and access filters for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.sources import store

K1, B = 1.5, 0.75
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.6, 0.4
#: A side is broadcast by hand only if its plan's size is known and at most this; else AQE decides.
BROADCAST_BYTES = 32 << 20
#: A batch of queries of up to so many numbers (terms, or vector components) is broadcast in blocks of BLOCK
#: weights; a larger batch is joined.
QUERY_NUMBERS, BLOCK = 4_000_000, 4_000_000
#: Scores of vectors with queries that a worker has at once; some six arrays of this size exist meanwhile.
SCORES = 1 << 19
#: Ids of a document's line chunks: no text has as many lines.
LINES = 1 << 31


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate is within BROADCAST_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def line_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of one line each, with ids, department and clearance."""
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "content")).select(
        "doc_id", (F.col("doc_id") * LINES + F.col("pos")).alias("chunk_id"), "pos", "content", F.col("source").alias("department"), (F.col("doc_id") % 4 + 1).cast("int").alias("clearance")
    )


def postings(chunks: DataFrame) -> DataFrame:
    """SNK-07, AGG-04: (chunk_id, term, tf).

    Chunks are dealt out by id before they are cut, so that the text is shuffled once, not every term of it.
    """
    chunks = chunks.select("chunk_id", "content").repartition("chunk_id")
    return chunks.select("chunk_id", F.explode(T.tokens(F.col("content"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl) of every chunk."""
    return chunks.select("chunk_id", F.size(T.tokens(F.col("content"))).cast("bigint").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: chunks, tokens, mean length."""
    return stats.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


@dataclass
class Index:
    """A sparse index: tokens(chunk_id, tokens) of each chunk, vocabulary(term, df), stats (n, total, avgdl), one row."""

    tokens: DataFrame
    vocabulary: DataFrame
    stats: DataFrame

    @staticmethod
    def of(chunks: DataFrame) -> "Index":
        """The index of chunks(chunk_id, content), computed anew by each search."""
        tokens = chunks.select("chunk_id", T.tokens(F.col("content")).alias("tokens"))
        terms = tokens.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
        return Index(tokens, terms.groupBy("term").agg(F.count("*").alias("df")), corpus_stats(tokens.select(F.size("tokens").alias("dl"))))

    def save(self, path: str) -> None:
        """SNK-07: tokenised once; the counts are taken from the stored tokens."""
        spark = self.tokens.sparkSession
        store.save(self.tokens, f"{path}/tokens")
        tokens = store.load(spark, f"{path}/tokens")
        terms = tokens.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
        store.save(terms.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term"), f"{path}/vocabulary")
        store.save(corpus_stats(tokens.select(F.size("tokens").alias("dl"))), f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Index | None":
        """SRC-09: the index stored under path, None where a part is missing."""
        parts = [store.load(spark, f"{path}/{name}") for name in ("tokens", "vocabulary", "stats")]
        return None if any(p is None for p in parts) else Index(*parts)


def bm25(source: DataFrame | Index, queries: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """RNK-01: (query_id, chunk_id, score, rank), the k best of each query over chunks or an index of them.

    Statistics are the whole corpus's; `keep` (chunk_id) only restricts which chunks are scored. A repeated
    query term scores repeatedly. Each task scores its chunks against blocks of queries as a matrix and sends
    on only each query's k best; a batch of very many queries is joined with the postings instead.
    """
    index = source if isinstance(source, Index) else Index.of(source)
    terms = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    tokens = index.tokens if keep is None else index.tokens.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = terms.join(index.vocabulary, "term").join(F.broadcast(index.stats)).select("query_id", "term", (F.col("qtf") * idf).alias("weight"), "avgdl")  # stats is one row
    some = weighted.limit(QUERY_NUMBERS + 1).toArrow()  # at most QUERY_NUMBERS rows of two numbers and a word are used
    if some.num_rows > QUERY_NUMBERS:
        return _joined(tokens, weighted, k)
    kind = [queries.schema["query_id"], tokens.schema["chunk_id"]]
    schema = S.StructType([S.StructField("query_id", kind[0].dataType), S.StructField("chunk_id", kind[1].dataType), S.StructField("score", S.DoubleType())])
    if not some.num_rows:
        return top(tokens.sparkSession.createDataFrame([], schema), k)
    known = pc.unique(some.column("term"))
    ids = pc.unique(some.column("query_id"))
    row, col = (np.asarray(pc.index_in(some.column(c), value_set=v)) for c, v in (("term", known), ("query_id", ids)))
    weight, avgdl = some.column("weight").to_numpy(), some.column("avgdl")[0].as_py()
    shared = tokens.sparkSession.sparkContext.broadcast((known, ids, row, col, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, row, col, weight = shared.value
        blocks = []
        width = max(1, BLOCK // len(known))
        for a in range(0, len(ids), width):
            pick = (col >= a) & (col < a + width)
            w = np.zeros((len(known), min(width, len(ids) - a)))
            w[row[pick], col[pick] - a] = weight[pick]
            blocks.append((a, w))
            if len(blocks) * w.size > 4 * BLOCK:
                break
        whole = sum(w.shape[1] for _, w in blocks) == len(ids)
        for b in batches:
            lists = b.column(1)
            dl = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
            no = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            chunk = np.repeat(np.arange(len(dl)), dl)
            hit = no >= 0
            key, tf = np.unique(chunk[hit] * np.int64(len(known)) + no[hit], return_counts=True)
            chunk, term = key // len(known), key % len(known)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[chunk] / avgdl))
            todo = blocks if whole else ((a, _dense_block(known, row, col, weight, a, min(width, len(ids) - a))) for a in range(0, len(ids), width))
            for a, w in todo:
                for rows, score in _scores(chunk, term, part, w):
                    at, q, s = best(score, rows, b.column(0), k)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + a)), b.column(0).take(pa.array(at)), pa.array(s)], names=["query_id", "chunk_id", "score"])

    return top(tokens.mapInArrow(run, schema), k)


def _dense_block(known, row, col, weight, a: int, width: int) -> np.ndarray:
    pick = (col >= a) & (col < a + width)
    w = np.zeros((len(known), width))
    w[row[pick], col[pick] - a] = weight[pick]
    return w


def _scores(chunk: np.ndarray, term: np.ndarray, part: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, their scores against a block of queries) in pieces of bounded size; a chunk's postings stand together."""
    new = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.empty(0, np.int64)
    step, i = max(1, (BLOCK // 2) // w.shape[1]), 0
    while i < len(new):
        j = max(i + 1, int(np.searchsorted(new, new[i] + step)))
        a, z = new[i], new[j] if j < len(new) else len(chunk)
        yield chunk[new[i:j]], np.add.reduceat(w[term[a:z]] * part[a:z, None], new[i:j] - a, axis=0)
        i = j


def best(score: np.ndarray, rows: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the k best positive scores of each column, rounded; ties by the lower id."""
    score = np.round(score, 6)
    if len(score) > k:
        least = np.partition(score, -k, axis=0)[-k]
    else:
        least = np.full(score.shape[1], -np.inf)
    r, q = np.nonzero((score >= least) & (score > 0))
    at, s = rows[r], score[r, q]
    ident = np.asarray(ids)[at]
    order = np.lexsort((ident, -s, q))
    at, q, s = at[order], q[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return at[keep], q[keep], s[keep]


def _joined(tokens: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """bm25() for a batch of queries that no worker could hold: postings of the queries' terms joined with them."""
    wanted = weighted.select("term").distinct()
    hits = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    hits = hits.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return top(scored.withColumn("score", F.round("score", 6)), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by score, then id, with their rank (a window group limit)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """CMP-03's core: 0 for zero vectors; accumulated in double."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length > 0, dot / length).otherwise(F.lit(0.0))


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RNK-02: exact cosine top k of queries(query_id, qvec) over vectors(chunk_id, vec), in double precision.

    A stated query set against all rows: each task multiplies its vectors with blocks of queries and sends on
    only each query's k best. Vectors of another length than the query's, and null ones, are no hits; a zero
    vector scores 0. A batch of queries beyond QUERY_NUMBERS components is joined instead.
    """
    asked = queries.select("query_id", "qvec")
    size = asked.agg(F.coalesce(F.sum(F.size("qvec")), F.lit(0))).first()[0]
    if size > QUERY_NUMBERS:
        pairs = vectors.join(asked).where(F.size("vec") == F.size("qvec"))  # a stated query set against all rows
        return top(pairs.select("query_id", "chunk_id", F.round(cosine(F.col("vec"), F.col("qvec")), 6).alias("score")), k)
    got = asked.where("qvec is not null").toArrow()  # at most QUERY_NUMBERS components
    ids, lists = got.column("query_id").combine_chunks(), got.column("qvec").to_pylist()
    schema = S.StructType([S.StructField("query_id", queries.schema["query_id"].dataType), S.StructField("chunk_id", vectors.schema["chunk_id"].dataType), S.StructField("score", S.DoubleType())])
    by = {n: [i for i, v in enumerate(lists) if len(v) == n] for n in {len(v) for v in lists}}
    shared = vectors.sparkSession.sparkContext.broadcast((ids, {n: (np.array(at), np.array([lists[i] for i in at], float).reshape(len(at), n)) for n, at in by.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for b in batches:
            size = np.asarray(pc.fill_null(b.column(1).value_lengths(), -1))
            for n, (who, q) in queries.items():
                at = np.flatnonzero(size == n)
                if not len(at):
                    continue
                x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
                length = np.sqrt((x * x).sum(1))
                step = max(1, SCORES // len(at))
                for a in range(0, len(q), step):
                    part = q[a : a + step]
                    scale = length[:, None] * np.sqrt((part * part).sum(1))[None]
                    score = np.where(scale > 0, x @ part.T / np.where(scale > 0, scale, 1), 0.0)
                    # shifted above zero, as every row is a hit
                    r, c, s = best(score + 2, at, b.column(0), k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[c + a])), b.column(0).take(pa.array(r)), pa.array(np.round(s - 2, 6) + 0.0)], names=["query_id", "chunk_id", "score"])

    return top(vectors.select("chunk_id", "vec").mapInArrow(run, schema), k)


def merge(dense_hits: DataFrame, sparse_hits: DataFrame) -> DataFrame:
    """JON-04: full outer join of two ranked lists."""
    d = dense_hits.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse_hits.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    return d.join(s, ["query_id", "chunk_id"], "full_outer")


def _ordered(df: DataFrame, k: int) -> DataFrame:
    """RNK-06: fused, dense and sparse score descending (absent: -1), id modulo a million, id."""
    w = Window.partitionBy("query_id").orderBy(
        F.desc("fused"), F.desc(F.coalesce("dense_score", F.lit(-1.0))), F.desc(F.coalesce("sparse_score", F.lit(-1.0))), F.col("chunk_id") % 1000000, "chunk_id"
    )
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(pool: DataFrame, k: int = 10, rrf_k=RRF_K, dense_weight=DENSE_WEIGHT, sparse_weight=SPARSE_WEIGHT) -> DataFrame:
    """RNK-03: weighted reciprocal rank fusion; weights and rrf_k may be columns."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    part = lambda w, r: F.coalesce(col(w) / (col(rrf_k) + F.col(r)), F.lit(0.0))
    return _ordered(pool.withColumn("fused", F.round(part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank"), 9)), k)


def weighted(pool: DataFrame, k: int = 10, dense_weight=DENSE_WEIGHT, sparse_weight=SPARSE_WEIGHT) -> DataFrame:
    """RNK-04: weighted min-max fusion; a list without range gives 1, an absent side 0."""
    w = Window.partitionBy("query_id")
    col = lambda v: v if isinstance(v, Column) else F.lit(v)

    def norm(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(F.col(c).isNull(), 0.0).when(high > low, (F.col(c) - low) / (high - low)).otherwise(1.0)

    return _ordered(pool.withColumn("fused", F.round(col(dense_weight) * norm("dense_score") + col(sparse_weight) * norm("sparse_score"), 9)), k)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, strategy: str = "rrf", k: int = 10, **weights) -> DataFrame:
    """RNK-05: strategy is rrf, weighted_score, dense_only or sparse_only."""
    pool = merge(dense_hits, sparse_hits)
    if strategy == "weighted_score":
        return weighted(pool, k, **weights)
    if strategy == "dense_only":
        return rrf(pool.where("dense_rank is not null"), k, dense_weight=1.0, sparse_weight=0.0)
    if strategy == "sparse_only":
        return rrf(pool.where("sparse_rank is not null"), k, dense_weight=0.0, sparse_weight=1.0)
    if strategy != "rrf":
        raise ValueError(f"unknown strategy {strategy!r}")
    return rrf(pool, k, **weights)


def explain(strategy: str = "rrf") -> Column:
    """RNK-07: why a fused row was found."""
    both = F.format_string(f"dense rank %d and sparse rank %d, {strategy} fusion", "dense_rank", "sparse_rank")
    return F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), both).when(F.col("dense_rank").isNotNull(), F.format_string("dense rank %d", "dense_rank")).otherwise(F.format_string("sparse rank %d", "sparse_rank"))


# Fixed values of the intent rules.
IDENTIFIERS = (
    r"\brfc-\d+\b", r"\biso-\d+\b", r"\berror_\d+\b", r"\bv\d+\.\d+(?:\.\d+)?\b", r"(?:^|\s|[.,;!?])c\+\+(?:\s|$|[.,;!?])", r"\bform\s+[a-z0-9\-]+\b",
    r"\bclause[_\s]+\d+(?:\.\d+)*\b", r"\bsection[_\s]+\d+(?:\.\d+)*\b", r"\b[a-z]+[_\-]\d+\b", r"\b\d+[_\-][a-z]+\b", r"\b[a-z]+\d+[a-z0-9_\-]*\b",
)
QUESTION_WORDS = (
    "how", "why", "what", "when", "where", "which", "who", "whom", "whose", "explain", "describe", "compare", "summarize", "define", "outline", "list",
    "can", "could", "should", "would", "is", "are", "does", "do",
)


def intent(query: Column) -> Column:
    """RNK-08: struct(kind, dense_weight, sparse_weight, pool)."""
    s = F.trim(F.coalesce(query, F.lit("")))
    parts = F.split(s, r"\s+")
    n = F.size(parts)
    asks = F.array(*[F.lit(w) for w in QUESTION_WORDS])
    first = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"^[?,.!]+|[?,.!]+$", "")
    opens = F.array_contains(asks, first) | F.exists(F.slice(parts, 1, 2), lambda w: F.array_contains(asks, F.lower(w)))
    made = lambda k, d, p, m: F.struct(F.lit(k).alias("kind"), F.lit(d).alias("dense_weight"), F.lit(p).alias("sparse_weight"), F.lit(m).alias("pool"))
    return (
        F.when(s == "", made("keyword_search", 0.5, 0.5, 1.0))
        .when(F.lower(s).rlike("|".join(IDENTIFIERS)), made("exact_identifier", 0.25, 0.75, 1.5))
        .when(s.endswith("?") | (opens & (n >= 3)), made("semantic_question", 0.75, 0.25, 1.2))
        .when(n <= 3, made("keyword_search", 0.4, 0.6, 1.0))
        .otherwise(made("mixed", 0.6, 0.4, 1.0))
    )


def hybrid(chunks: DataFrame | Index, vectors: DataFrame, queries: DataFrame, k: int = 10, pool: int = 50, strategy: str = "rrf", tune: bool = True) -> DataFrame:
    """RNK-09: both searches, intent weights and pool depth per query, fusion, explanation; queries(query_id, query, qvec)."""
    q = queries.withColumn("intent", intent(F.col("query")))
    depth = F.floor(F.lit(pool) * F.col("intent.pool")).cast("int") if tune else F.lit(pool)
    plan = q.select("query_id", F.when(F.col("intent.kind") == "semantic_question", depth).otherwise(F.lit(pool)).alias("dd"), F.when(F.col("intent.kind") == "exact_identifier", depth).otherwise(F.lit(pool)).alias("sd"), F.col("intent.dense_weight").alias("wd"), F.col("intent.sparse_weight").alias("ws"))
    d = dense(vectors, q, 2 * pool).join(small(plan.select("query_id", "dd")), "query_id").where("rank <= dd")
    s = bm25(chunks, q, 2 * pool).join(small(plan.select("query_id", "sd")), "query_id").where("rank <= sd")
    merged = merge(d, s).join(small(plan.select("query_id", "wd", "ws")), "query_id")
    wd, ws = (F.col("wd"), F.col("ws")) if tune else (DENSE_WEIGHT, SPARSE_WEIGHT)
    out = weighted(merged, k, wd, ws) if strategy == "weighted_score" else rrf(merged, k, RRF_K, wd, ws)
    return out.withColumn("why", explain(strategy))


def allowed(chunks: DataFrame, departments: list[str] | None = None, documents: DataFrame | None = None, clearance: int | None = None, strict: bool = True) -> DataFrame:
    """FLT-01/02: rows a caller may see. An empty allow-list sees nothing; strict=False keeps it open as dense search did."""
    if departments is not None and (strict or departments):
        chunks = chunks.where(F.col("department").isin(*departments)) if departments else chunks.where(F.lit(False))
    if documents is not None:
        chunks = chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    if clearance is not None:
        chunks = chunks.where(F.coalesce("clearance", F.lit(1)) <= clearance)
    return chunks


# Levels of the known roles.
ROLE_CLEARANCE = {"Employee": 1, "HR_Manager": 2, "Legal": 3, "Admin": 4}


def role_clearance(roles: Column) -> Column:
    """FLT-04: highest level of a list of roles, clamped to 1..4."""
    table = F.create_map(*[F.lit(x) for kv in ROLE_CLEARANCE.items() for x in kv])
    level = F.array_max(F.transform(roles, lambda r: F.coalesce(F.element_at(table, r), F.lit(1))))
    return F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce(level, F.lit(1))))


def may(roles: Column, needed: list[str], level: int) -> Column:
    """FLT-05: admins, holders of a needed role, or enough clearance."""
    return F.arrays_overlap(roles, F.array(*[F.lit(r) for r in [*needed, "Admin"]])) | (role_clearance(roles) >= level)
