"""A bit table of fixed size that turns rows away before a shuffle.

It never turns a wanted row away; what it lets through wrongly, the join behind it drops.
Its size doesn't depend on the input: with more keys than bits it only filters less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 26


def bit_rows(df: DataFrame, column: Column, bits: int = FILTER_BITS) -> DataFrame:
    """bucket, bits: a bit for each value of the column's low ``bits`` bits, 32768 to a row."""
    place = F.pmod(column, F.lit(1 << bits)) + 1
    return df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def bit_table(df: DataFrame, column: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """The bits of bit_rows() as one array of 2**bits / 8 bytes."""
    table = np.zeros(1 << bits >> 3, np.uint8)
    for r in bit_rows(df, column, bits).collect():  # 2**bits / 32768 rows of 4 KB at most
        table[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return table


def in_table(table: np.ndarray, values: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    place = (values & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def only_marked(rows: DataFrame, key: Column, marks: DataFrame, marked: bool = True, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key (a long) has its bit in the saved bit_rows(), or all others.

    The broadcast side is 2**bits / 8 bytes at most."""
    place = F.pmod(key, F.lit(1 << bits)) + 1
    joined = rows.join(F.broadcast(marks), F.bitmap_bucket_number(place) == F.col("bucket"), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    on = F.coalesce(F.getbit(byte, at % 8).cast("int"), F.lit(0)) == 1
    return joined.filter(on if marked else ~on).select(*rows.columns)
