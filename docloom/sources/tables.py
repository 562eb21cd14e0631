"""Sources: tables, files, structured blocks, JSON fixtures and stored indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources import store

BENCHMARK = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("query_type", T.StringType()),
    T.StructField("expected_chunk_ids", T.ArrayType(T.StringType())), T.StructField("relevance_grades", T.MapType(T.StringType(), T.DoubleType())),
])
CORPUS = "id string, document_id string, title string, department_name string, content string, section_path string, page_number int, token_count int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """SRC-04: a key lookup that the scan pushes down."""
    return df.where(F.col(column) == F.lit(value))


def chunks_of(chunks: DataFrame, document_id, version_id=None) -> DataFrame:
    """SRC-05: chunks of a document version, null-safe, in order."""
    return chunks.where((F.col("document_id") == F.lit(document_id)) & F.col("version_id").eqNullSafe(F.lit(version_id))).orderBy("chunk_index")


def binary_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[dict]] | None = None, strict: bool = False) -> DataFrame:
    """SRC-01..03: files with title, hash and error; with an extractor, their blocks.

    extract(content) gives blocks as dicts of page, text, x0, y0, x1, y1, size, bold; what it raises becomes
    the row's error, or the job's with strict.
    """
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), "_", " ")
    error = F.when(F.col("length") == 0, "empty document").when(~(F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")), "not a pdf").when(F.decode("content", "iso-8859-1").contains("/Encrypt"), "encrypted")
    files = files.select("path", stem.alias("title"), "length", F.sha2("content", 256).alias("file_hash"), error.alias("error"), "content")
    if strict:
        files = files.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error"))))
    if extract is None:
        return files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c, e in zip(b["path"], b["content"], b["error"]):
                try:
                    blocks = [] if e else extract(bytes(c))
                except Exception as x:
                    if strict:
                        raise
                    blocks, e = [], str(x)
                rows += [(p, e, i, d["page"], d["text"], d["x0"], d["y0"], d["x1"], d["y1"], d["size"], d["bold"]) for i, d in enumerate(blocks)] or [(p, e, *[None] * 9)]
            yield pd.DataFrame(rows, columns=["path", "error", "block", "page", "text", "x0", "y0", "x1", "y1", "size", "bold"])

    return files.mapInPandas(run, "path string, error string, block long, page long, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def document_texts(documents: DataFrame, chunks: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """SRC-07: chunks joined by blank lines, else the fallback's text (document_id, text)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda s: s["content"]), "\n\n")
    out = documents.select("document_id").join(chunks.groupBy("document_id").agg(joined.alias("chunked")), "document_id", "left")
    if fallback is None:
        return out.select("document_id", F.col("chunked").alias("text"))
    return out.join(fallback.select("document_id", F.col("text").alias("other")), "document_id", "left").select("document_id", F.coalesce("chunked", "other").alias("text"))


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: an array of chunks."""
    return spark.read.schema(CORPUS).json(path, multiLine=True)


def benchmark_json(spark: SparkSession, path: str, part: str = "tuning_set") -> DataFrame:
    """SRC-08: one set of a benchmark object."""
    schema = T.StructType([T.StructField(part, T.ArrayType(BENCHMARK))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(part).alias("q")).select("q.*")


def stored_index(spark: SparkSession, path: str, columns: set[str]) -> DataFrame | None:
    """SRC-09: None if missing; an index without the columns raises."""
    df = store.load(spark, path)
    if df is not None and (lost := columns - set(df.columns)):
        raise ValueError(f"{path} lacks {sorted(lost)}")
    return df


def warm_up(spark: SparkSession, path: str, build: Callable[[], DataFrame], columns: set[str]) -> DataFrame:
    """SRC-10: the stored index, built first where it is missing."""
    found = stored_index(spark, path, columns)
    if found is None:
        store.save(build(), path)
        found = store.load(spark, path)
    return found
