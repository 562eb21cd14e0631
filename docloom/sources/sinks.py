"""Sinks: uploads, deduplicating and replacing writes, index maintenance, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import retrieval
from docloom.sources import store

MOST_BYTES = 50 << 20


def checked_uploads(files: DataFrame) -> DataFrame:
    """SNK-01: binary files with clean name, hash, target name and error."""
    name = T.file_name(F.col("path"))
    error = F.when(~F.lower(name).endswith(".pdf"), "extension").when(F.length("content") > MOST_BYTES, "too large").when(~(F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")), "not a pdf")
    digest = F.sha2("content", 256)
    return files.select("path", name.alias("name"), digest.alias("file_hash"), F.concat(F.substring(digest, 1, 16), F.lit("_"), name).alias("target"), error.alias("error"))


def delete_path(spark: SparkSession, path: str) -> bool:
    """SNK-02."""
    return store.delete(spark, path)


def dedup_upsert(new: DataFrame, old: DataFrame, hash_column: str = "file_hash", order: str = "created_at", key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """SNK-03: (rows to insert, duplicate rows with the row that stands for them)."""
    w = Window.partitionBy(hash_column).orderBy(order, key)
    first = new.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(key).over(w))
    known = old.groupBy(hash_column).agg(F.min(key).alias("_known"))
    both = first.join(known, hash_column, "left")
    insert = both.where("_n = 1 and _known is null").select(*new.columns)
    duplicate = both.where("_n > 1 or _known is not null").select(*new.columns, F.coalesce("_known", "_first").alias("duplicate_of"))
    return insert, duplicate


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-04/05: old rows whose (null-safe) keys are not in new, and new."""
    k = new.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    on = None
    for c in keys:
        e = old[c].eqNullSafe(k[f"_{c}"])
        on = e if on is None else on & e
    return old.join(k, on, "left_anti").unionByName(new)


def checked_vectors(vectors: DataFrame, dim: int, column: str = "vec") -> DataFrame:
    """SNK-05: a vector of another length fails the job."""
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("vector length "), F.size(column).cast("string"))).cast(vectors.schema[column].dataType)))


save = store.save


def build_sparse(chunks: DataFrame, path: str) -> None:
    """SNK-07: postings sorted by term, and what retrieval.Index searches, under path."""
    save(retrieval.postings(chunks).sortWithinPartitions("term", "chunk_id"), f"{path}/postings")
    retrieval.Index.of(chunks).save(path)


def build_dense(chunks: DataFrame, embed: Callable, path: str, dim: int) -> None:
    """SNK-06: vectors by an Arrow-batched embedder of text series."""
    vec = F.pandas_udf(embed, "array<float>")
    save(checked_vectors(chunks.select("chunk_id", "doc_id", "clearance", "department", vec("content").alias("vec")), dim), f"{path}/vectors")


def dual_index(builders: dict[str, Callable[[], None]]) -> dict[str, str | None]:
    """SNK-08, SNK-11: each index is built on its own; name to error, None where it succeeded."""
    out: dict[str, str | None] = {}
    for name, build in builders.items():
        try:
            build()
            out[name] = None
        except Exception as e:  # the other index must still be built
            out[name] = str(e)
    return out


def delete_version(index: DataFrame, document_id, version_id=None, whole_document: bool = False) -> DataFrame:
    """SNK-09: rows left. A null version removes only rows without version, or with whole_document the document."""
    mine = F.col("document_id").eqNullSafe(F.lit(document_id))
    if whole_document and version_id is None:
        return index.where(~mine)
    return index.where(~(mine & F.col("version_id").eqNullSafe(F.lit(version_id))))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """SNK-15: every table without the rows of the deleted keys."""
    return {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def append(df: DataFrame, path: str, tolerate: bool = False) -> str | None:
    """SNK-12/13: the error's text if the write may fail."""
    try:
        df.write.mode("append").parquet(path)
    except Exception as e:
        if not tolerate:
            raise
        return str(e)
    return None


def report_json(df: DataFrame, path: str) -> None:
    """SNK-14: for reports of bounded size."""
    df.coalesce(1).write.mode("overwrite").json(path)
