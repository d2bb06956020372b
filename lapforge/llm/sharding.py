"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of their keys. A keyed Feistel network over
the smallest even number of bits that holds N permutes the numbers; results of N or
more are permuted again until they fall below N (cycle walking), which leaves a
bijection on 0..N-1. The permuted number p gives shard ``p % n`` and slot ``p // n``,
so shard counts differ by one at most, slots have no gaps, and both directions can
be computed for any row number without the table (``place`` and ``row_at``).

Law: ``rows``. Rows with equal texts are not kept together: a group of copies that
holds a third of all rows can't lie in one shard whose count is N/16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .text import as_column, hidden, numbered_columns, others, quoted

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Permutation:
    """A reproducible bijection on 0..n-1 for a seed."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = _U((1 << self.half) - 1)
        with np.errstate(over="ignore"):
            self.keys = _mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed % (1 << 64)))

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> _U(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ (_mix(right + key) & self.mask)
        # the halves leave swapped, so that the same network with its keys reversed undoes it
        return (right << _U(self.half)) | left

    def _walk(self, x, keys) -> np.ndarray:
        x = np.array(x, dtype=_U, ndmin=1)
        with np.errstate(over="ignore"):
            x = self._pass(x, keys)
            while (out := x >= _U(self.n)).any():
                x[out] = self._pass(x[out], keys)
        return x.astype(np.int64)

    def place(self, row) -> np.ndarray:
        return self._walk(row, self.keys)

    def row_at(self, position) -> np.ndarray:
        return self._walk(position, self.keys[::-1])


def place(row: int, n_rows: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(Permutation(n_rows, seed).place(row)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n_rows: int, n_shards: int, seed: int = 0) -> int:
    """Row number in a slot of a shard."""
    return int(Permutation(n_rows, seed).row_at(slot * n_shards + shard)[0])


def number_rows(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with the rows' numbers 0..N-1 in the order of ``keys``, and N.

    One range shuffle, no window over all rows. The numbered parts are written once,
    as sampled range bounds may differ between runs; their counts (one row for each
    part) give the offsets. Rows equal in all keys are numbered in any order.
    """
    part, at, start, count = (hidden(x) for x in ("part", "at", "start", "count"))
    by = [quoted(k) for k in keys]
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = hidden("tie")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n_parts, *by, tie)
    parts = dealt.sortWithinPartitions(*by, tie).drop(tie)
    low = F.lit((1 << 33) - 1)
    parts = materialize(parts.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(low).alias(at)), "numbered")
    total, starts = 0, []
    # one row for each of n_parts parts reaches the driver
    for row in sorted(parts.groupBy(part).agg(F.count(F.lit(1)).alias(count)).collect()):
        starts.append((row[part], total))
        total += row[count]
    offsets = spark.createDataFrame(starts, f"{part} int, {start} long")
    numbered = parts.join(F.broadcast(offsets), part)  # n_parts rows at most
    return numbered.select(*map(quoted, df.columns), (F.col(start) + F.col(at)).alias(name)), total


def shard(df: DataFrame, keys: list[str], n_shards: int = 16, seed: int = 0) -> DataFrame:
    """Columns of ``df`` with ``row_no``, ``shard`` and ``slot``.

    Reproducible for the same rows, keys, seed and ``n_shards``, however they are
    partitioned. Nulls in keys come first. Repeated rows each get a place of their
    own. An empty table stays empty. Columns of these three names, in any case, are replaced. Pass
    only columns that are needed: what ``df`` holds goes through the shuffle.
    """
    df = df.select(*map(quoted, others(df.columns, ["row_no", "shard", "slot"])))
    numbered, total = number_rows(df, keys, "row_no")
    plain = numbered_columns(numbered)
    schema = T.StructType([*plain.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches):
        rule = Permutation(total, seed)
        for batch in batches:
            p = rule.place(batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], names=[f.name for f in schema])

    return plain.mapInArrow(run, schema).toDF(*numbered.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 0, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot.

    A null text has no bytes: size 1 and checksum 0, as an empty one. A null doc_id
    comes first. Only these small columns are shuffled, never the text. Rows that
    agree in doc_id, size, checksum and 64-bit hash of the text are told apart by
    nothing else; which of them has which of their places is open.
    """
    body = as_column(text)
    small = docs.select(
        as_column(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias(hidden("hash")),
    )
    keys = ["doc_id", "text_crc32", "size", hidden("hash")]
    return shard(small, keys, n_shards, seed).select("doc_id", "size", "text_crc32", "shard", "slot")
