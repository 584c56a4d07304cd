"""Small files and folders in any file system that Spark reaches: text, exclusive creation, moves."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(path: str):
    """(JVM, path, file system) of a path; relative ones are within the file system's working folder."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(str(path))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, fs.makeQualified(at), fs


def exists(path: str) -> bool:
    _, at, fs = _place(path)
    return fs.exists(at)


def read_text(path: str) -> str:
    """Raises FileNotFoundError where there is no such file."""
    jvm, at, fs = _place(path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(path: str, text: str) -> None:
    """Writes a file that must not exist yet; FileExistsError otherwise, also where another process has just made it."""
    _, at, fs = _place(path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def replace_text(path: str, text: str) -> None:
    """Writes beside the file and renames, so a reader sees the old or the new content."""
    folder, _, name = path.rpartition("/")
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    create_text(beside, text)
    jvm, source, fs = _place(beside)
    spark = SparkSession.getActiveSession()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(source, _place(path)[1], over)


def make_folder(path: str) -> None:
    _, at, fs = _place(path)
    fs.mkdirs(at)


def delete(path: str) -> None:
    """Deletes a file or folder; nothing where there is none."""
    _, at, fs = _place(path)
    fs.delete(at, True)


def move(source: str, target: str) -> None:
    """Puts a folder in the place of another one, which goes."""
    _, old, fs = _place(target)
    fs.delete(old, True)
    if not fs.rename(_place(source)[1], old):
        raise OSError(f"{source} cannot be moved to {target}")


def copy(source: str, target: str) -> None:
    jvm, at, fs = _place(source)
    _, to, other = _place(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, to, False, True, fs.getConf()):
        raise OSError(f"{source} cannot be copied to {target}")


def names(folder: str) -> list[str]:
    """Names in a folder, in order."""
    _, at, fs = _place(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def resolve_input(value: str, folder: str = "files") -> str:
    """A path as given, or the file of that name in the folder of inputs."""
    for path in (value, f"{folder}/{value}"):
        if exists(path):
            return path
    raise FileNotFoundError(f"{value}: neither a path nor a file in {folder}")
