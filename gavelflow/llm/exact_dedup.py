"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by successive digits of their bytes. A digit is a run of bytes,
short at first and eight times wider on each level, so that most documents part ways
on their first bytes and a text of n bytes needs about log8(n / 64) levels. A group
that holds one document is finished: the document is unique. A group whose texts have
ended is finished too: its documents are equal, byte by byte, without any digest. Only
documents of larger, unended groups go to the next level.

Each level counts its groups with map-side combination, writes those of two or more
(few) and joins them to the documents; that join is the only place where a frequent
text meets itself, and its document side can be split by adaptive execution. A bit table
over the written groups, of BITS_EACH bits a group and of 8 MB at most, keeps most unique
documents out of the shuffle. The tables of all levels are broadcast together in the end.

Defined cases: null text counts as empty, empty texts are equal; of equal texts the row
with the largest id stays, null ids being smallest; of several rows with that id (or
with no id at all) exactly one stays; an empty table gives an empty result; extra
columns never take part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.llm.bitfilter import FILTER_BITS, bit_rows, only_marked
from gavelflow.llm.scratch import Scratch

FIRST_DIGIT = 64
WIDENING = 8
#: At least so many bits of the table for each group, and the bits of its smallest size.
BITS_EACH, LEAST_BITS = 32, 15


def filter_bits(groups: int) -> int:
    """The logarithm of a bit table's size for so many groups."""
    return min(FILTER_BITS, max(LEAST_BITS, (groups * BITS_EACH).bit_length()))


def _groups(docs: DataFrame, id_col: str, text_col: str, carry: dict, keep_body: bool, first: int) -> DataFrame:
    """carry columns, x_keep (id that stays), x_size, x_kept of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = docs.select(
        F.col(id_col).alias("x_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("x_body"),
        F.lit(0).cast("long").alias("x_group"),
        *[c.alias(name) for name, c in carry.items()],
    )
    out, offset, width, level = [], 0, first, 0
    while True:
        dealt = rows.withColumns({
            "x_digit": F.substring("x_body", offset + 1, width),
            "x_ended": F.length("x_body") <= offset + width,
        })
        counted = dealt.groupBy("x_group", "x_digit", "x_ended").agg(F.count(F.lit(1)).alias("x_size"), F.max("x_id").alias("x_keep")).filter("x_size > 1")
        groups = scratch.save(counted.withColumn("x_next", F.monotonically_increasing_id()), f"groups{level}")
        key = F.xxhash64("x_group", "x_digit", "x_ended")
        bits = filter_bits(groups.count())
        marks = scratch.save(bit_rows(groups, key, bits), f"marks{level}")
        alone = only_marked(dealt, key, marks, marked=False, bits=bits)
        joined = only_marked(dealt, key, marks, bits=bits).join(groups.hint("merge"), ["x_group", "x_digit", "x_ended"], "left")
        unended = F.col("x_size").isNotNull() & ~F.col("x_ended")
        body = F.col("x_body") if keep_body else F.when(unended, F.col("x_body"))
        table = scratch.save(
            joined.select("x_id", body.alias("x_body"), "x_next", "x_size", "x_keep", unended.alias("x_open"), *carry),
            f"rows{level}",
        )
        single = alone.select("x_id", *carry).unionByName(table.filter("x_size IS NULL").select("x_id", *carry))
        single = single.select(*carry, F.col("x_id").alias("x_keep"), F.lit(1).cast("long").alias("x_size"), F.lit(True).alias("x_kept"))
        equal = table.filter("x_size IS NOT NULL AND NOT x_open")
        turn = F.row_number().over(Window.partitionBy("x_next", "x_id").orderBy(F.lit(0)))
        equal = equal.withColumn("x_kept", F.col("x_id").eqNullSafe(F.col("x_keep")) & (turn == 1)).select(*carry, "x_keep", "x_size", "x_kept")
        out += [single, equal]
        if groups.filter("NOT x_ended").isEmpty():
            break
        rows = table.filter("x_open").select("x_id", "x_body", F.col("x_next").alias("x_group"), *carry)
        offset, width, level = offset + width, width * WIDENING, level + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carry = {"doc_id": F.col(id_col), "text_sha256": F.sha2(text.cast("binary"), 256)}
    found = _groups(docs, id_col, text_col, carry, False, first_digit)
    return found.select("doc_id", F.col("x_keep").alias("keep_id"), F.col("x_size").alias("group_size"), F.col("x_kept").alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """docs without the rows that another row with the same text outlives."""
    carry = {"x_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    found = _groups(docs, id_col, text_col, carry, False, first_digit)
    return found.filter("x_kept").select("x_row.*")
