"""A revision of a table's content, whatever the order and layout of its rows.

Each row has a SHA-256 of its columns' values, each with its length in bytes before it; the
revision is the SHA-256 of the row count and the sums of the digests' four quarters (15 of
16 digits of each, so that sums of 10^20 rows are exact). Sums combine on the map side.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 4


def _text(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def row_digest(df: DataFrame) -> Column:
    told = [F.coalesce(F.concat(F.octet_length(_text(f)).cast("string"), F.lit(":"), _text(f)), F.lit("-")) for f in df.schema.fields]
    return F.sha2(F.concat(*told), 256)


def word_sums(df: DataFrame) -> list[Column]:
    """The aggregates w0 to w3 that a revision is made of."""
    digest = row_digest(df)
    return [F.coalesce(F.sum(F.conv(F.substring(digest, 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"w{k}") for k in range(WORDS)]


def revision_of(rows: int, sums: dict) -> str:
    return hashlib.sha256(":".join([str(rows), *[str(sums.get(f"w{k}", 0)) for k in range(WORDS)]]).encode()).hexdigest()


def revision(df: DataFrame) -> str:
    told = df.agg(F.count(F.lit(1)).alias("rows"), *word_sums(df)).first().asDict()
    return revision_of(told["rows"], told)
