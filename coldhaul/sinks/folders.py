"""Small file operations of the driver, on any file system that Spark reaches."""

from __future__ import annotations

import os
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store, store.makeQualified(where)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark reports locations."""
    return _located(spark, path)[1].toString()


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _located(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds; nothing happens if it is missing."""
    store, where = _located(spark, path)
    store.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    store, where = _located(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a path or pattern names; those in the folders it names."""
    store, where = _located(spark, pattern)
    found = store.globStatus(where)
    if not found:
        raise FileNotFoundError(pattern)
    files = []
    for status in found:
        inner = store.listStatus(status.getPath()) if status.isDirectory() else [status]
        files += [s.getPath().toString() for s in inner if not s.isDirectory()]
    return sorted(files)


def content(spark: SparkSession, folder: str) -> str:
    """Number and bytes of the files below a folder; any append changes it."""
    store, where = _located(spark, folder)
    if not store.exists(where):
        return "0 files"
    summary = store.getContentSummary(where)
    return f"{summary.getFileCount()} files of {summary.getLength()} bytes"


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _located(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file, unless it exists: of several callers at a time one gets True.

    On local disks the file appears with its content; a store that creates files
    exclusively, such as HDFS, may show it empty for a moment.
    """
    store, where = _located(spark, path)
    store.mkdirs(where.getParent())
    if store.getScheme() == "file":
        target = where.toUri().getPath()
        draft = f"{target}.{uuid.uuid4().hex}"
        with open(draft, "w") as out:
            out.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        stream = store.create(where, False)
    except Py4JJavaError:
        if store.exists(where):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True
