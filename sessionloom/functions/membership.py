"""Bloom filters as tables: a row for a block of 512 bits, made and asked by expressions in the JVM.

A key sets one bit in each of the eight words of one block, so asking needs the
one row of that block: an equi join, or a look at the rows that a scan gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Keys for a block: about 16 bits a key, one false answer in a thousand.
KEYS = 32


def blocks_for(keys: Column) -> Column:
    """How many blocks so many keys need."""
    return F.greatest(F.lit(1), F.ceil(keys / KEYS)).cast("long")


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _bit(key: Column, word: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit(WORDS)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bits_of(key: Column) -> list[Column]:
    """``w0`` to ``w7``: the bit that a key sets in each word."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key, i)).alias(f"w{i}") for i in range(WORDS)]


def built(keys: DataFrame, key: Column, blocks: Column, *by: str) -> DataFrame:
    """``by, block, w0..w7`` of the keys; bits are combined before anything is shuffled."""
    rows = keys.select(*by, block_of(key, blocks).alias("block"), *bits_of(key))
    return rows.groupBy(*by, "block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def holds(words: list[Column], bits: list[Column]) -> Column:
    """Whether a block's words have all of a key's bits; null where there is no block."""
    out = F.lit(True)
    for have, want in zip(words, bits):
        out = out & (have.bitwiseAND(want) != 0)
    return out
