"""Token ids in binary files that can be read by document.

A part file is a row of independent zstandard frames, then two skippable frames:
the documents' range of each frame, and a seek table in the public seekable
format (compressed size, raw size and checksum of each frame, then a footer).  A
reader takes the end of the file, finds a document's frame and decompresses that
frame alone, after checking it against the table's checksum.

A frame's raw bytes: ``n`` (u32), then for each document its id (i64), 1 if the
id is null (u8) and its number of ids (u32), then all ids (u32 little endian).
Documents stand in ascending order of id (null first) across and within parts.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, lean, pick, prepare, shuffle_partitions
from .tokens import encoder, tokenizer_path

SKIPPABLE, RANGES, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_BYTES = 1 << 18
_RANGE = struct.Struct("<qqBI")
_DOC = struct.Struct("<qBI")
_PARTS = "part long, path string, n_docs long, n_tokens long, n_bytes long, low long, high long"
_NAMES = tuple(x.split()[0] for x in _PARTS.split(", "))


#: Hadoop's names of schemes that pyarrow knows by others.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def arrow_uri(uri: str) -> str:
    """The URI of a shared folder as pyarrow has it."""
    scheme, colon, rest = uri.partition("://")
    return _SCHEMES.get(scheme, scheme) + colon + rest if colon else uri


def _fs(uri: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


class Writer:
    """Writes one part file; memory holds one frame and the tables."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.at, self.seek, self.ranges = out, 0, [], []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.docs: list[tuple[int | None, bytes]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.size += len(ids) + _DOC.size
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.docs:
            return
        heads = (_DOC.pack(i or 0, i is None, len(ids) // 4) for i, ids in self.docs)
        raw = b"".join([struct.pack("<I", len(self.docs)), *heads, *(ids for _, ids in self.docs)])
        frame = self.pack(raw)
        self.out.write(frame)
        self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        low, high = self.docs[0][0], self.docs[-1][0]
        self.ranges.append((low or 0, high or 0, (low is None) | (high is None) << 1, len(self.docs)))
        self.at += len(frame)
        self.docs, self.size = [], 0

    def close(self) -> int:
        self.flush()
        ranges = b"".join(_RANGE.pack(*x) for x in self.ranges)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        tail = struct.pack("<II", RANGES, len(ranges)) + ranges + struct.pack("<II", SKIPPABLE, len(table)) + table
        self.out.write(tail)
        return self.at + len(tail)


class Reader:
    """Reads a part file from any seekable file."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        self.last: tuple[int, list] = (-1, [])
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("not a token file: no seek table at its end")
        start = size - 9 - 12 * n
        ranges = start - 8 - _RANGE.size * n
        file.seek(ranges - 8)
        tail = file.read(size - 9 - ranges + 8)
        if struct.unpack("<II", tail[:8]) != (RANGES, _RANGE.size * n):
            raise ValueError("not a token file: no table of ranges")
        self.ranges = list(_RANGE.iter_unpack(tail[8 : 8 + _RANGE.size * n]))
        self.seek = list(struct.iter_unpack("<III", tail[16 + _RANGE.size * n : 16 + (_RANGE.size + 12) * n]))
        self.starts = [0]
        for x in self.seek:
            self.starts.append(self.starts[-1] + x[0])

    def frame(self, k: int) -> list[tuple[int | None, bytes]]:
        """Documents of the k-th frame; a checksum that doesn't hold is an error.  The last one is remembered."""
        if k != self.last[0]:
            self.last = (k, self._frame(k))
        return self.last[1]

    def _frame(self, k: int) -> list[tuple[int | None, bytes]]:
        import xxhash

        packed, size, checksum = self.seek[k]
        self.file.seek(self.starts[k])
        raw = self.unpack(self.file.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: wrong checksum")
        (n,) = struct.unpack_from("<I", raw)
        at, out = 4 + n * _DOC.size, []
        for doc_id, null, count in _DOC.iter_unpack(raw[4:at]):
            out.append((None if null else doc_id, raw[at : at + 4 * count]))
            at += 4 * count
        return out

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of every document of that id, from the frames that can hold it."""
        highs = [-(1 << 63) if flags & 2 else high for _, high, flags, _ in self.ranges]
        out = []
        for k in range(bisect.bisect_left(highs, doc_id), len(self.ranges)):
            low, _, flags, _ = self.ranges[k]
            if not flags & 1 and low > doc_id:
                break
            out += [ids for i, ids in self.frame(k) if i == doc_id]
        return out


def _write(path: str, folder: str, end: bytes):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = encoder(path)
        fs, root = _fs(folder)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        attempt, final = f"{root}/_attempts/{part}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.tok"
        docs = count = 0
        low = high = None
        with fs.open_output_stream(attempt) as out:
            writer = Writer(out)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = tokens.encode([text])[0] + end
                    writer.add(doc_id, ids)
                    low, high = doc_id if low is None else low, doc_id
                    docs, count = docs + 1, count + len(ids) // 4
            size = writer.close()
        if docs:
            fs.move(attempt, final)  # a second attempt puts the same bytes in its place
            row = (part, final, docs, count, size, low, high)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if x is final else pa.int64()) for x in row], _NAMES)
        else:
            fs.delete_file(attempt)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them as part files in ascending order of id.

    Returns the parts (``part, path, n_docs, n_tokens, n_bytes``, the least and
    greatest id ``low, high``, and ``start``, the ids in all parts before), which
    also go to ``manifest.json`` in
    ``folder``.  ``folder`` must be one that all executors share.

    A null text is an empty one; rows with a null id come first; rows that share
    an id keep a place beside each other, ordered by their text; no rows give no
    parts.
    """
    spark = docs.sparkSession
    prepare(spark)
    end = b"" if end_id is None else struct.pack("<I", end_id)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # the text's hash lets the range bounds part rows that share an id
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    written = ranged.select("doc_id", "text").mapInArrow(_write(tokenizer_path(tokenizer), folder, end), _PARTS)
    parts, start = [], 0
    for x in sorted(written.collect(), key=lambda x: x["part"]):  # one row for a part file
        parts.append((*x, start))
        start += x["n_tokens"]
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    fs.create_dir(f"{root}/_attempts")
    fs.delete_dir(f"{root}/_attempts")  # what failed tasks have left
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "parts": [dict(zip((*_NAMES, "start"), x)) for x in parts]}).encode())
    return spark.createDataFrame(parts, _PARTS + ", start long")


def _read(folder: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with fs.open_input_file(path) as file:
                    reader = Reader(file, size)
                    for k in range(len(reader.seek)):
                        found = reader.frame(k)
                        starts = []
                        for _, ids in found:
                            starts.append(start)
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([i for i, _ in found], pa.int64()),
                                pa.array(starts, pa.int64()),
                                pa.array([len(ids) // 4 for _, ids in found], pa.int64()),
                                pa.array([zlib.crc32(ids) for _, ids in found], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def _listed(spark: SparkSession, folder: str) -> list[dict]:
    fs, root = _fs(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())["parts"]


def read_token_files(spark: SparkSession, folder: str, parts: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` counts the ids of all documents before it, in ascending order of
    id; repeated and null ids give the rows they were written from, an empty text
    a row with its end id alone; a folder without parts gives none.
    """
    prepare(spark)
    if parts is None:
        parts = spark.createDataFrame([tuple(x.values()) for x in _listed(spark, folder)], _PARTS + ", start long")
    return (
        parts.repartition(shuffle_partitions(spark), "part")
        .select("path", "n_bytes", "start")
        .mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def _parts_of(bounds):
    """The part files whose range holds an id; ranges ascend and may share an end."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = ([-(1 << 63) if x is None else x for x in side] for side in bounds.value)
        for batch in batches:
            rows = [(k, i) for i in batch.column(0).to_pylist() for k in range(bisect.bisect_left(highs, i), bisect.bisect_right(lows, i))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], []))], ["at", "doc_id"])

    return run


def _pick_documents(folder: str, files):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        at = file = reader = None
        for batch in batches:
            rows = []
            for k, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != at:
                    if file is not None:
                        file.close()
                    path, size = files.value[k]
                    at, file = k, fs.open_input_file(path)
                    reader = Reader(file, size)
                rows += [(doc_id, np.frombuffer(ids, np.uint32)) for ids in reader.find(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])
        if file is not None:
            file.close()

    return run


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of the wanted documents; only the frames that hold them are decompressed.

    Each distinct id of ``wanted`` is looked up once; an id that several rows were
    written under gives each of them, one that isn't there and null give none.
    """
    prepare(spark)
    listed = _listed(spark, folder)
    if not listed:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    # a row for a part file: bounded by the number of partitions that wrote them
    bounds = spark.sparkContext.broadcast(([x["low"] for x in listed], [x["high"] for x in listed]))
    files = spark.sparkContext.broadcast([(x["path"], x["n_bytes"]) for x in listed])
    ids = pick(wanted, doc_id=id_col).select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    placed = ids.mapInArrow(_parts_of(bounds), "at long, doc_id long").repartition("at").sortWithinPartitions("at", "doc_id")
    return placed.mapInArrow(_pick_documents(folder, files), "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "token-files")
    parts = write_token_files(docs, folder, "word_bpe_49k.json", end_id=1)
    return read_token_files(spark, folder, parts)
