"""Small text files next to the data, through Hadoop's file system so any storage works."""
from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted child names of a folder; empty when it does not exist."""
    fs, p, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then put it in place in one step: readers find the old file or the new one, never none."""
    fs, p, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(p), overwrite)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A folder under another name, file by file; what is there is replaced."""
    (at, a, jvm), (to, b, _) = _fs(spark, source), _fs(spark, target)
    if at.makeQualified(a).equals(to.makeQualified(b)):
        return
    to.delete(b, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(at, a, to, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False when it is there already.  Of several writers exactly one is told True."""
    fs, p, jvm = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        if fs.getScheme() == "file":  # Hadoop's local file system looks and creates in two steps
            jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
    except Py4JJavaError as exc:
        if "AlreadyExists" in str(exc.java_exception.getClass().getName()):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str) -> str:
    """First line of a file; of a folder, that of its first non-empty part file."""
    fs, p, jvm = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        lines = (first_line(spark, f"{path}/{n}") for n in names(spark, path) if not n.startswith(("_", ".")))
        return next(filter(None, lines), "")
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str))


def read_json(spark: SparkSession, path: str, default=None):
    return json.loads(read_text(spark, path)) if exists(spark, path) else default
