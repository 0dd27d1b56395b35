"""Token counts through a digest cache.

Contents are known by the SHA-256 of their UTF-8 bytes, and a tokenizer by the
SHA-256 of its file and settings.  Counts that a cache table already holds for
that pair are joined; only distinct contents that it lacks are encoded, and
their counts are appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exists, fresh_dir, lean, pick, prepare, staged
from .tokens import encoder, tokenizer_digest, tokenizer_path

CACHE = "tokenizer string, digest binary, n_tokens long"


@lean
def _distinct_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass on the first row of each digest, texts compressed for the shuffle."""
    import zstandard

    pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
    for batch in batches:
        digests, packed = [], []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                packed.append(pack(text.encode()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["digest", "packed"])


def _encode(path: str, name: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, seen, tokens = zstandard.ZstdDecompressor().decompress, set(), encoder(path)
        for batch in batches:
            digests, counts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(len(tokens.encode([unpack(packed).decode()])[0]) // 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(digests), pa.string()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs``.

    ``tokenizer`` is a file of the tokenizers library (a path, or a public
    tokenizer's name), used without special tokens.  ``cache_path`` is a Parquet
    table that persists between runs; without it the run has a cache of its own.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows each give a row; no rows give an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer_path(tokenizer)
    name = tokenizer_digest(path)
    cache_path = cache_path or fresh_dir(spark, "token-counts")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = staged(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    contents = rows.select("digest", "text").mapInArrow(_distinct_in_task, "digest binary, packed binary")
    if exists(spark, cache_path):
        known = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == name)
        missing = keyed.select("digest").distinct().join(known.select("digest").distinct(), "digest", "left_anti")
        contents = contents.join(missing, "digest", "left_semi")
    # each task has already dropped its own repeats, so the most common content comes once from a task
    contents = contents.repartition("digest")
    contents.mapInArrow(_encode(path, name), CACHE).write.mode("append").option("compression", "zstd").parquet(cache_path)
    # rows of one content may be many: adaptive execution splits such a partition of this
    # join, which it can do only where no aggregate stands between the exchange and the join
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = staged(counts, "counts")
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, "byte_bpe_50k.json")
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
