"""Files by URI, from the driver (through Hadoop) and from executors (through pyarrow)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .workspace import ship

#: Hadoop's names of schemes that pyarrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
DIGESTS = "path string, size long, sha256 string"


def arrow_fs(uri: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":/")
    if not colon:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:/{rest}" if scheme != "file" else "file:///" + rest.lstrip("/"))


def hadoop(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return bool(fs.delete(p, True))


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename; false if the target is there already."""
    p, fs = hadoop(spark, source)
    to, _ = hadoop(spark, target)
    fs.mkdirs(to.getParent())
    return not fs.exists(to) and bool(fs.rename(p, to))


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """A file that appears whole: written beside its place and renamed."""
    tmp, fs = hadoop(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(data))
    out.close()
    to, _ = hadoop(spark, path)
    fs.delete(to, False)
    fs.rename(tmp, to)


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """A new file; false if there is one already.  The file system decides between several that try at once."""
    p, fs = hadoop(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(data))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> bytes:
    p, fs = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path below the folder, size, time of change in ms) of every file in it, in order."""
    p, fs = hadoop(spark, folder)
    if not fs.exists(p):
        return []
    base, out, files = p.toUri().getPath().rstrip("/") + "/", [], fs.listFiles(fs.makeQualified(p), True)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toUri().getPath().removeprefix(base), f.getLen(), f.getModificationTime()))
    return sorted(out)


def folders(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of the entries right below a folder."""
    p, fs = hadoop(spark, folder)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _digest(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_fs(folder)
        for batch in batches:
            sizes, digests = [], []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                with fs.open_input_stream(f"{root}/{path}") as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                        size += len(block)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["path", "size", "sha256"])

    return run


def digests(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """``path, size, sha256`` of files below a folder, read in pieces where executors are, whatever their size."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    ship(spark)
    return rows.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInArrow(_digest(folder), DIGESTS)


def _copy(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (from_fs, a), (to_fs, b) = arrow_fs(source), arrow_fs(target)
        for batch in batches:
            sizes, digests = [], []
            for path in batch.column(0).to_pylist():
                digest, size, place = hashlib.sha256(), 0, f"{b}/{path}"
                beside = f"{place}.{uuid.uuid4().hex}"
                to_fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with from_fs.open_input_stream(f"{a}/{path}") as f, to_fs.open_output_stream(beside) as out:
                    while block := f.read(1 << 20):
                        out.write(block)
                        digest.update(block)
                        size += len(block)
                to_fs.move(beside, place)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["path", "size", "sha256"])

    return run


def copied(spark: SparkSession, source: str, target: str, paths: list[str]) -> set[tuple[str, int, str]]:
    """Copy files from one folder to another, in tasks; (path, size, sha256) of what went through.

    A file is written beside its place and moved there, so a task that is tried
    again does no harm.  A manifest bounds the number of its files.
    """
    ship(spark)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    dealt = rows.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))
    return {(r["path"], r["size"], r["sha256"]) for r in dealt.mapInArrow(_copy(source, target), DIGESTS).collect()}
