"""Marks rows whose key may be among the wanted ones, without shuffling the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 MB, whatever the number of keys: the bound of what is broadcast.
BITS = 27


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, name: str = "_maybe", bits: int = BITS) -> DataFrame:
    """Adds ``name``: false only where the key (a 64-bit hash) is certainly not in the one column of ``wanted``.

    The bitmap of the wanted hashes is broadcast in blocks of 4 kB.  Rows marked true need an exact join; where the bitmap is full
    all rows are.  A null key is never marked.
    """
    hashed = wanted.toDF("key").where("key is not null").select(F.pmod("key", F.lit(1 << bits)).alias("p"))
    bitmap = hashed.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_map"))
    place = F.pmod(key, F.lit(1 << bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    joined = rows.withColumn("_at", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), F.col("_at") == F.col("_bucket"), "left")
    return joined.select(*columns, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False)).alias(name))
