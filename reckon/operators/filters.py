"""Bloom filters of key sets as rows: one for each set, in blocks of 256 bits that partial aggregates build.

A key sets eight bits of one block, two in each of its four words, so testing a
key reads one row. A filter says "maybe" of about one absent key in a hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each key of a set, and in a block.
BITS, BLOCK = 12, 256
WORDS = ("w0", "w1", "w2", "w3")


def key_hash(*keys: Column) -> Column:
    """64 bits over the keys, nulls told apart from values by their places."""
    return F.xxhash64(*[x for k in keys for x in (k, k.isNull())])


def blocks(count: Column) -> Column:
    """Blocks of the filter of a set of ``count`` keys."""
    return F.greatest(F.ceil(count * BITS / BLOCK), F.lit(1)).cast("long")


def place(hash_: Column, many: Column) -> Column:
    """The key's block among ``many``."""
    return F.pmod(F.xxhash64(hash_, F.lit(0)), many)


def masks(hash_: Column) -> list[Column]:
    """The bits that a key sets in each word of its block."""
    out = []
    for k in range(len(WORDS)):
        bits = F.xxhash64(hash_, F.lit(k + 1))
        one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
        out.append(one(bits).bitwiseOR(one(F.shiftright(bits, 32))))
    return out


def built(keys: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """by, block and the four words of ``keys`` (by, hash); ``sets`` (by, blocks) has a row a set."""
    placed = keys.join(sets.select(*by, "blocks"), by).select(*by, place(F.col("hash"), F.col("blocks")).alias("block"), *[m.alias(w) for w, m in zip(WORDS, masks(F.col("hash")))])
    return placed.groupBy(*by, "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def maybe(keys: DataFrame, filters: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``keys`` (by, hash, blocks and others) that the filter of their set may hold."""
    asked = keys.withColumn("block", place(F.col("hash"), F.col("blocks")))
    both = asked.join(filters, [*by, "block"])
    held = F.lit(True)
    for w, m in zip(WORDS, masks(F.col("hash"))):
        held &= F.col(w).bitwiseAND(m) == m
    return both.where(held).select(*keys.columns)
