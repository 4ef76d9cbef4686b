"""The file system behind Spark's paths: scratch folders, deletion, and small files that are written whole."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers report it."""
    at, files = _at(spark, path)
    return files.makeQualified(at).toString().rstrip("/")


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; unset, a temporary one if all tasks run in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in that folder, for files that stay."""
    return f"{folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder, deleted when the session ends."""
    path = fresh(spark, name)
    at, files = _at(spark, path)
    files.deleteOnExit(at)
    return path


def held(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch path: computed once, however often it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._held_at = path
    return out


def delete_held(df: DataFrame) -> None:
    """Delete a table that ``held`` made and no plan will read again."""
    delete(df.sparkSession, df._held_at)


def write_whole(spark: SparkSession, path: str, content: bytes) -> None:
    """Write beside, then rename: a reader sees the old or the new file."""
    at, files = _at(spark, path)
    fresh, _ = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(at), options)
