"""Sorting out rows by a key set without moving them: a bitmap of a fixed size over hashed keys, broadcast.

A row whose bit is unset is surely not in the set. A row whose bit is set may be; an exact join decides there. The
bitmap's size doesn't depend on the data: where a corpus outgrows it, more rows go to the exact join, and the result is
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB, in rows of 4 KB.
BITS = 26


def marked(df: DataFrame, key: Column, keys: DataFrame, key_name: str, out: str) -> DataFrame:
    """``df`` with a boolean column ``out``: false where ``key`` is surely none of ``keys[key_name]``."""
    place = F.pmod(F.xxhash64(F.col(key_name)), F.lit(1 << BITS))
    bits = keys.select(place.alias("_b")).groupBy(F.expr("_b div 32768").alias("_part")).agg(F.bitmap_construct_agg(F.col("_b") % 32768).alias("_bits"))
    own = F.pmod(F.xxhash64(key), F.lit(1 << BITS))
    octet = F.conv(F.hex(F.substr("_bits", (F.expr("_bit div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_own", own)
        .withColumns({"_part": F.expr("_own div 32768"), "_bit": F.col("_own") % 32768})
        .join(F.broadcast(bits), "_part", "left")
        .withColumn(out, F.coalesce(F.col("_bits").isNotNull() & (F.getbit(octet, (F.col("_bit") % 8).cast("int")) == 1), F.lit(False)))
        .drop("_own", "_part", "_bit", "_bits")
    )
