"""A blocked Bloom filter as a DataFrame: a row of eight 64-bit words for each block.

A key sets one bit in each word of one block. The filter has 16 bits a key up to MAX_BLOCKS
blocks, so its broadcast is bounded; a longer list makes it pass more, never less, and the exact
join behind it stays right. Everything is built-in functions: built by bit_or, tested by a
broadcast hash join on the block's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_A_BLOCK = 32
MAX_BLOCKS = 1 << 18  # 16 MB of bits
_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
_WORDS = [f"__lattica_w{i}" for i in range(8)]


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(blocks)).cast("int")


def _bit(h: Column, salt: int) -> Column:
    """1 << one of 64 places, from the hash's low half."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    place = F.shiftright((low * F.lit(salt % (1 << 32))).bitwiseAND(F.lit(0xFFFFFFFF)), 26)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter of a column of keys, and its number of blocks."""
    n = keys.count()
    blocks = 1
    while blocks * KEYS_A_BLOCK < n and blocks < MAX_BLOCKS:
        blocks *= 2
    h = F.xxhash64(F.col(key))
    words = keys.select(_block(h, blocks).alias("__lattica_block"), *(_bit(h, s).alias(w) for w, s in zip(_WORDS, _SALTS, strict=True)))
    return words.groupBy("__lattica_block").agg(*(F.bit_or(w).alias(w) for w in _WORDS)), blocks


def tested(rows: DataFrame, key: str, filter_: tuple[DataFrame, int], flag: str) -> DataFrame:
    """rows and a flag: false only if the key is not in the list."""
    words, blocks = filter_
    h = F.xxhash64(F.col(key))
    found = rows.withColumn("__lattica_block", _block(h, blocks)).join(F.broadcast(words), "__lattica_block", "left")
    holds = F.lit(True)
    for w, s in zip(_WORDS, _SALTS, strict=True):
        holds = holds & (F.coalesce(F.col(w), F.lit(0).cast("long")).bitwiseAND(_bit(h, s)) != 0)
    return found.withColumn(flag, holds).drop("__lattica_block", *_WORDS)
