"""Ranks within groups of any size.

Rows are range-partitioned by (group, order), so that a large group lies over many tasks.
Each task numbers its own rows; a group that reaches over task borders has the counts of
its earlier tasks added. Rows that are equal in all columns of the order are told apart by
their place in the input, so that they can be split as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.llm.scratch import Scratch


def ranked(df: DataFrame, group: list[str], order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """df and x_rank: the place, from 0, of each row in its group. Nulls are values of their own and come first.

    df should be read from a table, as the tie-break is the row's place in it."""
    dealt = df.withColumn("x_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "x_tie").withColumn("x_part", F.spark_partition_id())
    dealt = scratch.save(dealt, name)
    here = ["x_part", *group]
    local = dealt.withColumn("x_local", F.row_number().over(Window.partitionBy(*here).orderBy(*order, "x_tie")) - 1)
    counts = dealt.groupBy(*here).agg(F.count(F.lit(1)).alias("x_count"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only a group that goes on from an earlier task has counts before it: one a task at most.
    before = counts.withColumn("x_before", F.sum("x_count").over(earlier)).filter("x_before IS NOT NULL").drop("x_count")
    before = F.broadcast(before.select(*[F.col(c).alias(f"x_of_{c}") for c in here], "x_before"))
    same: Column = F.lit(True)
    for c in here:
        same = same & F.col(c).eqNullSafe(F.col(f"x_of_{c}"))
    rank = (F.col("x_local") + F.coalesce("x_before", F.lit(0))).cast("long")
    return local.join(before, same, "left").select(*df.columns, rank.alias("x_rank"))
