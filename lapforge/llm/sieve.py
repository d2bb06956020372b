"""A bounded sieve of keys: tells, before a shuffle, most rows that a join would drop.

Keys set bits of a table of ``WORDS`` words of 64 bits. The table has at most that many
rows whatever the number of keys, so it is broadcast; with very many keys it lets more
rows pass, which the join behind it drops as it would without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .text import hidden

#: Words of a sieve: 16,777,216 bits, 4 MB as rows.
WORDS = 1 << 18
#: Column of a row's word.
WORD = hidden("word")


def _place(key: Column) -> tuple[Column, Column]:
    """Word of a key, and its bit in it."""
    at = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.shiftrightunsigned(at, 6), F.lit(WORDS)).cast("int"), bit


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """(word, bits) of the keys: at most ``WORDS`` rows."""
    word, bit = _place(key)
    return materialize(keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "sieve")


def passing(df: DataFrame, key: Column, found: DataFrame, passes: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the sieve, with ``WORD``; or those whose key isn't.

    An anti join behind it must ask for ``WORD``, or it would be moved before the sieve.
    """
    word, bit = _place(key)
    bits, at = hidden("bits"), WORD
    table = F.broadcast(found.select(F.col("word").alias(at), F.col("bits").alias(bits)))  # WORDS rows at most
    held = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    if passes:
        return df.join(table, word == F.col(at)).filter(held).drop(bits)
    return df.join(table, word == F.col(at), "left").filter(~held).drop(at, bits)
