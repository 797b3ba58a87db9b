"""Files outside Spark's readers and writers: from tasks through Arrow, from the driver through the session's file system."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession

# File systems that Arrow opens, by scheme; Spark has other names for some of them.
ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def scheme_of(path: str) -> str:
    return path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"


def arrow_store(path: str):
    """Arrow's file system for a path, and the path in it. Spark gives paths as URIs, with some characters escaped."""
    from pyarrow import fs

    scheme = scheme_of(path)
    if scheme == "file":
        plain = unquote(path.removeprefix("file:")) if path.startswith("file:") else path
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}:{path.split(':', 1)[1]}")


def open_input(path: str):
    """A random-access file from any file system that Arrow reaches."""
    system, inner = arrow_store(path)
    return system.open_input_file(inner)


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, directory: str) -> list[str]:
    """Names of the files in a directory; none if there is no such directory."""
    system, where = _file(spark, directory)
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    system, where = _file(spark, path)
    system.delete(where, True)


def create_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a small file with all of its content unless it exists; false if it did.

    The content is written beside it, then given the name in one step that fails where the name is taken: a link on a
    local disk, elsewhere a rename of the file system, which must not replace files (HDFS and ABFS don't).
    """
    import uuid

    jvm, (system, where) = spark._jvm, _file(spark, path)
    where = system.makeQualified(where)
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    try:
        if where.toUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri()).toPath()
            jvm.java.nio.file.Files.createLink(local(where), local(beside))
        else:
            options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, where, options)
        return True
    except Exception as failure:
        if "FileAlreadyExists" in str(failure):
            return False
        raise
    finally:
        system.delete(beside, False)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a file of one line."""
    system, where = _file(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
