"""A Bloom filter of hash values as a table of bitmaps (JON-06).

The filter has at most ``MAX_BITS`` bits (16 MB) whatever it is built from, so
it can always be broadcast; beyond its size it only lets more rows through.
Rows that it turns away surely have no partner, and stay where they are; only
the others go through the exact shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest filter, bits per entry of a smaller one, bits that an entry sets.
MAX_BITS, BITS_PER_ENTRY, PROBES = 1 << 27, 16, 2
#: Bits of one bitmap of ``bitmap_construct_agg``.
_BITMAP = 4096 * 8


def filter_bits(entries: int) -> int:
    """Size of the filter: a power of two."""
    bits = _BITMAP
    while bits < MAX_BITS and bits < entries * BITS_PER_ENTRY:
        bits *= 2
    return bits


def _place(value: Column, probe: int, bits: int) -> Column:
    """The bit (from 1 on) that a value sets."""
    return F.pmod(F.xxhash64(value, F.lit(probe)), F.lit(bits).cast("long")) + 1


def bloom_filter(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(bucket, bits): the bitmaps of all non-null values, combined in the tasks before they are shuffled."""
    places = values.filter(F.col(column).isNotNull()).select(
        F.explode(F.array(*[_place(F.col(column), p, bits) for p in range(PROBES)])).alias("_at"))
    return places.groupBy(F.bitmap_bucket_number("_at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits"))


def maybe_in(df: DataFrame, column: str, bitmaps: DataFrame, bits: int, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: false if the value is surely not among those of the filter (null: false)."""
    result = F.col(column).isNotNull()
    for p in range(PROBES):
        table = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{p}"), F.col("bits").alias(f"_m{p}")))  # <= 16 MB
        at = _place(F.col(column), p, bits)
        df = df.join(table, F.bitmap_bucket_number(at) == F.col(f"_b{p}"), "left")
        bit = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(F.col(f"_m{p}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
        result = result & F.coalesce(is_set, F.lit(False))
    return df.withColumn(out, result).drop(*[c for p in range(PROBES) for c in (f"_b{p}", f"_m{p}")])
