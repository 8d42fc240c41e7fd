"""Jump consistent hashing of stable keys to shards, in DataFrame expressions only.

The generator is the published one (key * 2862933555777941757 + 1 modulo 2**64), kept as two halves of 32 bits so that
no product leaves the range of a long, whatever the session says about overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The multiplier of the generator, as high and low halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def _low_product(x: Column, c: int) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits."""
    upper = (F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(upper, 16) + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c)).bitwiseAND(F.lit(MASK))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    upper, lower = F.shiftright(low, 16) * F.lit(LOW), low.bitwiseAND(F.lit(0xFFFF)) * F.lit(LOW)
    total = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    return (carry + _low_product(high, LOW) + _low_product(low, HIGH)).bitwiseAND(F.lit(MASK)), total.bitwiseAND(F.lit(MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long key among ``shards``; with one more shard a key stays or moves to the new one."""
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"), long(-1).alias("at"), long(0).alias("to")
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        # The quotient uses the upper 31 bits of the new state: (b + 1) * 2**31 / (key >> 33 + 1).
        to = ((state["to"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")).cast("long")
        return F.when(state["to"] < shards, F.struct(high.alias("high"), low.alias("low"), state["to"].alias("at"), to.alias("to"))).otherwise(state)

    # Each step leads at least one shard further, so as many steps as shards are enough.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["at"].cast("int")


def assign(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", buckets: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: the key, ``size text_crc32 law shard slot grown_shard``.

    ``size`` is the number of bytes of the text plus 8; a null text has none and the checksum 0, as the empty text has.
    Keys are integers; a null key counts as key -1. Repeated rows share a shard and get slots of their own. Slots number the rows of a
    shard from 0 without gaps, by a hash of the row, then by key, so they are the same in every run.

    Rows that are alike in key, size and checksum are counted on the map side before anything is shuffled; numbering
    then goes by ``buckets`` hash buckets, each sorted by itself, behind the running totals of the buckets before it:
    a table of ``buckets * shards`` rows at most, whatever the size of the corpus. The text itself is never shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long"))
    same = docs.select(F.col(key).alias("key"), number.alias("n"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32")).groupBy("key", "n", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    # Neither is ever null; coalesce says so, and the join below needs no filter that would compute them once more.
    never = lambda x: F.coalesce(x, F.lit(0))
    rows = same.withColumn("shard", never(jump_hash(F.col("n"), shards))).withColumn("bucket", never(F.pmod(F.xxhash64("n", "size", "text_crc32"), F.lit(buckets)).cast("int")))

    totals = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = "coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    base = totals.select("shard", "bucket", F.expr(before).alias("base"))

    within = "coalesce(sum(copies) OVER (PARTITION BY bucket, shard ORDER BY n, key NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    numbered = rows.withColumn("first", F.expr(within)).join(base, ["shard", "bucket"])
    first = F.col("base") + F.col("first")
    slotted = numbered.withColumn("slot", F.explode(F.sequence(first, first + F.col("copies") - 1)))
    return slotted.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), jump_hash(F.col("n"), shards + 1).alias("grown_shard"))
