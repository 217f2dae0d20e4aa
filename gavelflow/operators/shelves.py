"""Rows sorted by a number within cells, for nearest-k searches that don't list all pairs.

A shelf holds, for each cell and each value of the number, the first rows of that value in a
given order (no search can want more of them). The values of a cell are numbered in order
and cut into blocks. A search finds its place in the order by one merge over the sorted
cells, and reads the blocks around it: its work depends on how far it reaches, not on how
many rows a cell has.

Cells of any size are dealt out by ranges, so that none is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.sources.scratch import written


def range_dealt(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, range-partitioned by order, with x_part, the number of the range; written."""
    tied = rows.withColumn("x_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "x_tie")
    return written(tied.withColumn("x_part", F.spark_partition_id()), name)


def _counted(dealt: DataFrame, cell: list[str], order: list[str], ones: dict[str, Column]) -> DataFrame:
    """dealt with a column for each of ones: its sum over the rows of the cell up to this one."""
    here = ["x_part", *cell]
    running = Window.partitionBy(*here).orderBy(*order, "x_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy(*here).agg(*[F.sum(one).alias(f"x_sum_{name}") for name, one in ones.items()])
    earlier = Window.partitionBy(*cell).orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only a cell that goes on from an earlier range has sums before it: one a range at most.
    carried = sums.withColumns({f"x_before_{name}": F.sum(f"x_sum_{name}").over(earlier) for name in ones})
    carried = carried.filter(f"x_before_{next(iter(ones))} IS NOT NULL").select(*here, *[f"x_before_{name}" for name in ones])
    rows = dealt.withColumns({name: F.sum(one).over(running) for name, one in ones.items()}).join(F.broadcast(carried), here, "left")
    return rows.withColumns({name: (F.col(name) + F.coalesce(f"x_before_{name}", F.lit(0))).cast("long") for name in ones}).drop(*[f"x_before_{name}" for name in ones])


class Shelf:
    """rows: cell columns, ``at`` and others; rows without ``at`` aren't on the shelf. Cell
    columns mustn't be null."""

    def __init__(self, rows: DataFrame, cell: list[str], at: str, first: list[Column], keep: int, block: int = 32):
        self.cell, self.at, self.block = cell, at, block
        others = [c for c in rows.columns if c not in (*cell, at)]
        turn = F.row_number().over(Window.partitionBy(*cell, at).orderBy(*first))
        kept = rows.filter(F.col(at).isNotNull()).withColumn("x_turn", turn).filter(F.col("x_turn") <= keep)
        values = kept.groupBy(*cell, at).agg(F.collect_list(F.struct(*others)).alias("x_items"))  # at most `keep`
        self.lists = written(values, "shelf-values")
        sizes = self.lists.select(*cell, at, F.size("x_items").alias("x_size"))
        placed = _counted(range_dealt(sizes, [*cell, at], "shelf-order"), cell, [at], {"x_place": F.lit(1), "x_upto": F.col("x_size")})
        place = F.col("x_place") - 1
        self.values = written(placed.select(*cell, at, "x_size", "x_upto", place.alias("x_place"), F.floor(place / block).cast("long").alias("x_block")), "shelf")

    def cells(self) -> DataFrame:
        return self.values.select(*self.cell).distinct()

    def places(self, searches: DataFrame, start: Column) -> DataFrame:
        """searches (cell columns and others) with x_start and x_below: how many values of their
        cell lie below start, and how many items."""
        others = [c for c in searches.columns if c not in self.cell]
        marks = self.values.select(*self.cell, F.col(self.at).cast("double").alias("x_at"), F.lit(1).alias("x_kind"), "x_size")
        asked = searches.select(*self.cell, start.cast("double").alias("x_at"), F.lit(0).alias("x_kind"), F.struct(*others).alias("x_search"))
        order = ["x_at", "x_kind"]
        dealt = range_dealt(asked.unionByName(marks, allowMissingColumns=True), [*self.cell, *order], "shelf-searches")
        counted = _counted(dealt, self.cell, order, {"x_start": F.col("x_kind"), "x_below": F.coalesce("x_size", F.lit(0))})
        return counted.filter("x_kind = 0").select(*self.cell, "x_search.*", "x_start", "x_below")

    def sizes(self, placed: DataFrame, reach: int, items: int | None = None) -> DataFrame:
        """placed with the values (``at``, x_size) of its cell that are among the ``reach`` next
        ones from the start up, or from there down; with ``items``, only those that fewer items
        than that lie before."""
        others = [c for c in placed.columns if c not in ("x_start", "x_below")]
        low, high = F.col("x_start") - reach, F.col("x_start") + (reach - 1)
        block = lambda place: F.floor(F.greatest(place, F.lit(0)) / self.block).cast("long")
        spots = placed.withColumn("x_block", F.explode(F.sequence(block(low), block(high))))
        near = spots.join(self.values, [*self.cell, "x_block"]).filter(F.col("x_place").between(low, high))
        if items is not None:
            between = F.when(F.col("x_place") < F.col("x_start"), F.col("x_below") - F.col("x_upto")).otherwise(F.col("x_upto") - F.col("x_size") - F.col("x_below"))
            near = near.filter(between < items)
        return near.select(*others, self.at, "x_size")

    def items(self, sized: DataFrame) -> DataFrame:
        """sized with x_items in place of x_size."""
        return sized.drop("x_size").join(self.lists, [*self.cell, self.at])

    def near(self, searches: DataFrame, start: Column, reach: int) -> DataFrame:
        return self.items(self.sizes(self.places(searches, start), reach))


def enough(values: DataFrame, by: list[str], order: list[Column], wanted: int | Column) -> DataFrame:
    """The values (x_size) of each search that come first, with ties, until ``wanted`` items are
    had; x_better: the items of those before."""
    same = Window.partitionBy(*by).orderBy(*order)
    better = F.sum("x_size").over(same.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("x_size").over(same.rangeBetween(Window.currentRow, Window.currentRow))
    return values.withColumn("x_better", better).filter(F.col("x_better") < wanted)


def unpacked(values: DataFrame) -> DataFrame:
    """A row for each item."""
    return values.withColumn("x_item", F.explode("x_items")).select(*[c for c in values.columns if c != "x_items"], "x_item.*")


def handed_out(rows: DataFrame, groups: DataFrame, lists: DataFrame, looks: list[str], most: int = 10_000) -> DataFrame:
    """rows beside x_all, the list of the group of rows that agree in ``looks``; those without one
    left out. groups: looks, x_group, x_rows (how many); lists: x_group, x_all. A list is laid
    out once for each ``most`` rows of its group, so no task takes all rows of a large one."""
    pieces = F.ceil(F.col("x_rows") / most).cast("int")
    cells = groups.select(*[F.col(x).alias(f"x_of_{x}") for x in looks], "x_group", pieces.alias("x_pieces"))
    same = [F.col(x).eqNullSafe(F.col(f"x_of_{x}")) for x in looks]
    spread = F.pmod(F.xxhash64(*rows.columns), F.col("x_pieces")).cast("int")
    asked = rows.join(cells, same).select(*rows.columns, "x_group", spread.alias("x_piece"))
    lists = lists.join(groups.select("x_group", pieces.alias("x_pieces")), "x_group").withColumn("x_piece", F.explode(F.sequence(F.lit(0), F.col("x_pieces") - 1)))
    return asked.join(lists.select("x_group", "x_piece", "x_all"), ["x_group", "x_piece"]).select(*rows.columns, "x_all")


def grouped(rows: DataFrame, looks: list[str], name: str) -> DataFrame:
    """looks, x_rows, x_group: what the rows agree in, counted and numbered; written."""
    return written(rows.groupBy(*looks).agg(F.count(F.lit(1)).alias("x_rows")).withColumn("x_group", F.monotonically_increasing_id()), name)


def latest_first(at: Column) -> Column:
    """A whole number that sorts as ``at`` does from the latest to null."""
    return F.coalesce(-F.unix_micros(at), F.lit(2**63 - 1))
