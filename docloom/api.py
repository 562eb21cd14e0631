"""Facade: one object for ingest, search, ask, compare, evaluate and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import audit, compare, evaluate, evidence, retrieval
from docloom.sources import sinks, tables


class Engine:
    """Batches of queries over chunks(doc_id, chunk_id, content, department, clearance) and vectors(chunk_id, vec)."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame | None = None):
        self.spark, self.chunks, self.vectors = spark, chunks, vectors

    def search(self, queries: DataFrame, k: int = 10, strategy: str = "rrf", departments=None, documents=None, clearance=None) -> DataFrame:
        keep = retrieval.allowed(self.chunks, departments, documents, clearance)
        if self.vectors is None:
            return retrieval.bm25(self.chunks, queries, k, keep)
        vectors = self.vectors.join(keep.select("chunk_id"), "chunk_id", "left_semi")
        d = retrieval.dense(vectors, queries, 5 * k)
        return retrieval.fuse(d, retrieval.bm25(self.chunks, queries, 5 * k, keep), strategy, k)

    def ask(self, queries: DataFrame, k: int = 10, scorer=evidence.overlap_scorer, provider=evidence.extractive_answers) -> DataFrame:
        hits = self.search(queries, 25)
        fused = F.col("fused") if "fused" in hits.columns else F.col("score")
        hits = hits.withColumn("fused", fused).join(self.chunks.select("chunk_id", "doc_id", "content", F.col("department").alias("section")), "chunk_id").join(queries.select("query_id", "query"), "query_id")
        best = evidence.compress(evidence.rerank(hits, scorer, 25, k))
        ranked = best.select("query_id", F.col("new_rank").alias("rank"), "chunk_id", "doc_id", "section", F.col("compressed").alias("text"), "tokens")
        items = evidence.pack(ranked, most=k).join(ranked.select("query_id", "chunk_id", "text"), ["query_id", "chunk_id"]).select(F.col("query_id").alias("answer_id"), "citation_id", "text")
        return evidence.synthesize(items, provider)

    compare = staticmethod(compare.compare)
    metrics = staticmethod(evaluate.metrics)
    audit_statistics = staticmethod(audit.statistics)
    audit_verify = staticmethod(audit.verify)
    dual_index = staticmethod(sinks.dual_index)
    read = staticmethod(tables.table)
