"""Files of whatever store Spark reads, by Hadoop's own interface."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file, or a folder that holds anything."""
    hadoop, system = _at(spark, path)
    return system.exists(hadoop) and (system.getFileStatus(hadoop).isFile() or any(True for _ in system.listStatus(hadoop)))


def delete(spark: SparkSession, path: str) -> None:
    hadoop, system = _at(spark, path)
    system.delete(hadoop, True)


def escaped(spark: SparkSession, value: str) -> str:
    """A partition's value as it stands in a folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if it isn't there."""
    hadoop, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(hadoop) if s.isDirectory()) if system.exists(hadoop) else []


def unescaped(spark: SparkSession, name: str) -> str:
    """A partition's value from what stands in a folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def names(spark: SparkSession, path: str) -> dict[str, float]:
    """The files in a folder with the time of their last change, in seconds; none if it isn't there."""
    hadoop, system = _at(spark, path)
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in system.listStatus(hadoop) if s.isFile()} if system.exists(hadoop) else {}


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all in a folder."""
    hadoop, system = _at(spark, path)
    return system.getContentSummary(hadoop).getLength()


def text(spark: SparkSession, path: str) -> str:
    hadoop, system = _at(spark, path)
    stream = system.open(hadoop)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, content: str) -> bool:
    """A file with this text, unless there is one: whether it was made. It is there whole or not at all.

    It is written under another name and renamed without overwriting, which the stores that Spark's own logs rely on do
    exclusively.
    """
    hadoop, system = _at(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{hadoop.getName()}.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(content.encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(hadoop).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(hadoop), no_options)
        return True
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
