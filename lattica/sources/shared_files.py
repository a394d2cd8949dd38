"""Small files on the file systems that Spark reads: created once, read, moved, deleted."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a file, or None if there is none."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether ``old`` became ``new``, which must not be there."""
    a, fs = _at(spark, old)
    b, _ = _at(spark, new)
    if fs.exists(b):
        return False
    fs.mkdirs(b.getParent())
    return fs.rename(a, b)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file unless it is there; of any number of writers, on any machines, one gets True, and nobody sees half a file.

    The text is written under a name of its own, which then becomes the real one: by a hard link on a local or mounted
    folder, by a rename that doesn't overwrite elsewhere.  Both fail if the file is there.
    """
    jvm = spark._jvm
    p, fs = _at(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    fs.mkdirs(p.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            there = lambda x: jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(there(p), there(draft))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(draft, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.toString():
            return False
        raise
    finally:
        fs.delete(draft, False)
