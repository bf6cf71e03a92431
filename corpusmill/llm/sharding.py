"""Sharding by jump consistent hashing, in DataFrame expressions alone.

A key's shard is the last of its jumps under the shard count (Lamping and
Veach, 2014): there is no ring table, and one more shard takes rows only into
itself. Spark has no wrapping product, so the generator's 64-bit step is made of
22-bit limbs.

Slots number a shard's rows from 0, in the order of id, size and checksum. Rows
are dealt by range, with a row number as the last part of the order, so that an
id that a third of all rows share, or copies of a row, are spread as well; each
range counts its rows of a shard, and the counts before it are its first slot.
No task holds a whole shard.

Defined results: a null text has no bytes; a null key counts as 0; repeated
rows have neighbouring slots; text keys go through xxhash64.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Fixed value: multiplier of the generator of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Rows of a range when slots are dealt.
RANGE_ROWS = 100_000
_LIMB = 22
_MASK = (1 << _LIMB) - 1
_FEW = 12


def _next(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, on signed longs."""
    c = [MULTIPLIER >> (_LIMB * i) & _MASK for i in range(3)]
    k = [key.bitwiseAND(F.lit(_MASK).cast("long")), F.shiftrightunsigned(key, _LIMB).bitwiseAND(F.lit(_MASK).cast("long")), F.shiftrightunsigned(key, 2 * _LIMB)]
    middle = k[0] * c[1] + k[1] * c[0]
    low = k[0] * c[0] + F.lit(1).cast("long") + F.shiftleft(middle.bitwiseAND(F.lit(_MASK).cast("long")), _LIMB)
    high = F.shiftrightunsigned(middle, _LIMB) + k[0] * c[2] + k[1] * c[1] + k[2] * c[0] + F.shiftrightunsigned(low, 2 * _LIMB)
    return F.shiftleft(high, 2 * _LIMB).bitwiseOR(low.bitwiseAND(F.lit((1 << 2 * _LIMB) - 1).cast("long")))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key, 0 to ``shards`` - 1.

    A key jumps as often as the natural logarithm of the count, on average; a
    few steps are laid out first, and the rest only for keys that need them.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.cast("long").alias("key"))

    def step(s: Column, _) -> Column:
        moved = common.let(
            _next(s["key"]),
            lambda k: F.struct(
                s["j"].alias("b"),
                F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long").alias("j"),
                k.alias("key"),
            ),
        )
        return F.when(s["j"] < shards, moved).otherwise(s)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(_FEW, shards))), start, step)
    if shards <= _FEW:
        return first["b"].cast("int")
    rest = lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards - _FEW)), s, step)["b"])
    return common.let(first, rest).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    as_key = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")) if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    text = F.coalesce("text", F.lit(""))
    rows = common.cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            jump_shard(as_key, shards).alias("shard"),
            jump_shard(as_key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    ranges = max(1, math.ceil(rows.count() / range_rows))
    order = ["doc_id", "size", "text_crc32", "row"]
    dealt = common.cut(rows.repartitionByRange(ranges, "shard", *order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "range", F.coalesce(before, F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order)) - 1
    return dealt.join(first, ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 goes byte by byte through its table; keys jump in a recursive query.
OP5_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(coalesce(text, '')) AS h FROM documents),
bytes AS (SELECT doc_id, size, list_concat([4294967295], list_transform(range(1, size - 15), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)) AS b FROM d),
sums AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, tab),
keys AS (SELECT DISTINCT doc_id, coalesce(doc_id, 0) AS k FROM documents),
jumps AS (
  SELECT doc_id, n, -1::BIGINT AS b, 0::BIGINT AS j, ((k::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS k FROM keys, (VALUES ({SHARDS}), ({SHARDS + 1})) c(n)
  UNION ALL
  SELECT doc_id, n, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((m // 8589934592)::DOUBLE + 1)))::BIGINT, m
  FROM (SELECT doc_id, n, j, (k * {MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT AS m FROM jumps WHERE j < n)
),
shards AS (SELECT doc_id, max(b) FILTER (n = {SHARDS} AND j >= {SHARDS}) AS shard, max(b) FILTER (n = {SHARDS + 1} AND j >= {SHARDS + 1}) AS grown FROM jumps GROUP BY 1)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard
FROM sums JOIN shards USING (doc_id)
"""
