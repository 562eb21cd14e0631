"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the context's checkpoint folder, or in local mode one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and (given := spark.sparkContext.getCheckpointDir()):
        d = given
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "docloom-checkpoints"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"


def path_of(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.delete(p, True)


POINTER = "CURRENT"


def save(df: DataFrame, path: str) -> None:
    """SNK-10: df becomes a new version folder under path, then a pointer file is replaced by one atomic rename.

    At every moment the pointer names a whole version; a crash leaves the old one in place.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    fs, pointer = path_of(spark, f"{path}/{POINTER}")
    before = current(spark, path)
    _, staged = path_of(spark, f"{path}/.{POINTER}-{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    rename = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    rename[0] = getattr(options, "Rename").OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(pointer).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(pointer), rename)
    if before:
        delete(spark, before)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that path's pointer names; None without one."""
    fs, pointer = path_of(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{path}/{name.strip()}"


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that save() wrote at path, or None."""
    found = current(spark, path)
    return spark.read.parquet(found) if found else None
