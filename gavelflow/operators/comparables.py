"""Closed sales that can stand for an open vehicle.

Best matches are found by a threshold-stop search, not by listing pairs. What a sale scores
depends on its cell (family, class, year, condition, operability) and, within that, falls
with the distance of the mileages. So a subject reads from each cell only the sales next
to its own mileage (``shelves``), takes the cells in rounds of falling bounds, and leaves out
those that its k-th score is above already. What it reads depends on k and on the number of
cells, not on how many sales a cell has.

Subjects that differ in nothing a search looks at (PROFILE) are searched for once. A search
goes over sizes of (cell, mileage) only; the sales themselves are read for those that it
chose, and each subject then leaves its own out.

Counts of candidates come from sales that are first counted by cell and mileage. Mileages
aren't negative. Subjects of no or no known mileage have no order to search by and are
held against all sales of their family, year by year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.functions import matching as M
from gavelflow.operators.shelves import Shelf, enough, grouped, handed_out, latest_first, unpacked
from gavelflow.sources.scratch import written

SUBJECT = ["id", "external_id", "family", "class", "year", "mileage", "condition", "operability", "vin", "issues"]
#: What guards and scores look at.
PROFILE = ["family", "class", "year", "mileage", "condition", "operability"]
COMP = ["auction_id", "family", "class", "year", "mileage", "condition", "operability", "vin", "issues", "closed_high_bid_cents", "ended_at"]


def latest_per_vin(comps: DataFrame) -> DataFrame:
    """The latest sale of each vehicle number; sales without one all stay. Ties: smallest auction id."""
    order = Window.partitionBy("vin").orderBy(F.desc("ended_at"), "auction_id")
    last = comps.filter("vin IS NOT NULL").withColumn("x_turn", F.row_number().over(order)).filter("x_turn = 1").drop("x_turn")
    return last.unionByName(comps.filter("vin IS NULL"))


def sides(subject_prefix: str = "s_", comp_prefix: str = "c_") -> tuple[dict[str, Column], dict[str, Column]]:
    return {c: F.col(subject_prefix + c) for c in SUBJECT}, {c: F.col(comp_prefix + c) for c in COMP}


def _renamed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def not_self() -> Column:
    """Neither the same auction nor the same known vehicle number."""
    s, c = sides()
    return ~s["external_id"].eqNullSafe(c["auction_id"]) & ~F.coalesce(s["vin"] == c["vin"], F.lit(False))


def _tier(reference_year: int) -> Column:
    """Of a pair that passes the family guards; the tight ones imply them."""
    s, c = sides()
    return F.when(M.guards(s, c, reference_year, M.TIGHT), M.TIGHT).otherwise(M.FAMILY)


def _banded(left: DataFrame, right: DataFrame, reference_year: int) -> DataFrame:
    """Pairs of one family whose years lie within the family band and whose classes agree: an
    equi-join on (family, class, year). Subjects without year or class match any."""
    s, _ = sides()
    left = left.filter("s_family IS NOT NULL")
    reach = M.most_years_apart(s["year"], reference_year, M.FAMILY)
    known = left.filter("s_year IS NOT NULL AND s_class IS NOT NULL")
    banded = known.withColumn("x_year", F.explode(F.sequence(s["year"] - reach, s["year"] + reach))).withColumn("x_class", F.explode(F.array("s_class", F.lit(""))))
    pairs = banded.join(right, (F.col("s_family") == F.col("c_family")) & (F.col("x_year") == F.col("c_year")) & (F.col("x_class") == F.coalesce("c_class", F.lit("")))).drop("x_year", "x_class")
    open_ended = left.filter("s_year IS NULL OR s_class IS NULL").join(right, F.col("s_family") == F.col("c_family"))
    return pairs.unionByName(open_ended)


def _class_banded(left: DataFrame, right: DataFrame, reference_year: int) -> DataFrame:
    """Pairs of one class whose years lie within the class band."""
    reach = M.most_years_apart(F.col("s_year"), reference_year, M.CLASS)
    banded = left.withColumn("x_year", F.explode(F.sequence(F.col("s_year") - reach, F.col("s_year") + reach)))
    return banded.join(right, (F.col("s_class") == F.col("c_class")) & (F.col("x_year") == F.col("c_year"))).drop("x_year")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each tier of each subject, ranked."""
    order = Window.partitionBy("s_id", "tier").orderBy(F.desc("score"), F.desc("c_ended_at"), "c_auction_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Lowest bounds of the rounds in which cells are read.
ROUNDS = (0.9, 0.8, 0.7, 0.55, 0.0)
#: A sale's cell on the shelves. Null is its own year (-1) and class (""); conditions that
#: aren't known score as "unknown".
CELL = ["x_family", "x_class", "x_year", "x_condition", "x_operability", "x_zone"]


def _zone() -> Column:
    """Mileages of zero, below FEW_MILES and from there: within a zone the guards pass an
    interval that begins where the search does."""
    return F.when(F.col("c_mileage") <= 0, 0).when(F.col("c_mileage") < M.FEW_MILES, 1).otherwise(2)


def _start() -> Column:
    few, many = F.least("s_mileage", F.lit(M.FEW_MILES - 1)), F.greatest("s_mileage", F.lit(M.FEW_MILES))
    return F.when(F.col("x_zone") == 0, F.lit(0)).when(F.col("x_zone") == 1, few).otherwise(many)


class Sales:
    """Closed sales on two shelves: by family, and over all families of a class."""

    def __init__(self, comps: DataFrame, k: int):
        self.k, self.rows = k, _renamed(comps, COMP, "c_")
        unknown = F.lit("unknown")
        cells = {"x_family": F.col("c_family"), "x_class": F.coalesce("c_class", F.lit("")), "x_year": F.coalesce("c_year", F.lit(-1)), "x_condition": F.coalesce("c_condition", unknown), "x_operability": F.coalesce("c_operability", unknown), "x_zone": _zone()}
        rows = self.rows.filter("c_mileage IS NOT NULL").withColumns(cells)
        # A subject's own auction and its own vehicle number may have to be passed over.
        self.reach = k + 2
        first = [F.desc("c_ended_at"), "c_auction_id"]
        items = [c for c in self.rows.columns if c not in ("c_class", "c_year", "c_condition", "c_operability")]
        self.by_family = Shelf(rows.filter("c_family IS NOT NULL").select(*CELL, *[c for c in items if c != "c_family"]), CELL, "c_mileage", first, self.reach)
        self.by_class = Shelf(rows.filter("c_class IS NOT NULL AND c_year IS NOT NULL").select(*CELL[1:], *items), CELL[1:], "c_mileage", first, self.reach)
        self.families = written(self.by_family.cells(), "family-cells")
        self.classes = written(self.by_class.cells(), "class-cells")

    @staticmethod
    def with_cell(rows: DataFrame) -> DataFrame:
        """rows with the comparable's columns that its cell tells."""
        return rows.withColumns({
            "c_class": F.when(F.col("x_class") != "", F.col("x_class")), "c_year": F.when(F.col("x_year") >= 0, F.col("x_year")), "c_condition": F.col("x_condition"), "c_operability": F.col("x_operability"),
        })

    def asked(self, rows: DataFrame, year: int, mode: int) -> DataFrame:
        """Subjects (s_*) beside the cells that they may draw on."""
        s, c = sides()
        return self.with_cell(rows).filter(M.kind_guards(s, c, year, mode))

    def valued(self, sized: DataFrame, year: int, mode: int, identity: float) -> DataFrame:
        """sized, where the mileage fits, with tier and score."""
        s, c = sides()
        values = self.with_cell(sized).filter(M.mileage_guard(s, c, mode))
        return values.withColumns({"tier": F.lit(M.CLASS) if mode == M.CLASS else _tier(year), "score": M.match_score(s, c, identity)})

    def sold(self, values: DataFrame, shelf: Shelf) -> DataFrame:
        """A row with c_* for each sale of the values."""
        rows = unpacked(shelf.items(values))
        return rows if "c_family" in rows.columns else rows.withColumn("c_family", F.col("x_family"))

    def found(self, placed: DataFrame, shelf: Shelf, year: int, mode: int, identity: float, reach: int | None = None) -> DataFrame:
        """s_*, c_*, tier, score of the sales nearest to each subject in each of its cells."""
        values = self.valued(shelf.sizes(placed, reach or self.reach, reach or self.reach), year, mode, identity)
        if reach is None:
            values = enough(values, ["s_id", "tier"], [F.desc("score")], self.reach)
        return self.sold(values, shelf).filter(not_self()).select(*[f"s_{x}" for x in SUBJECT], *[f"c_{x}" for x in COMP], "tier", "score")

    def of_family(self, profiles: DataFrame, year: int) -> DataFrame:
        """s_id, c_*, tier, score: the k + 2 best tight and family matches of profiles (s_id and
        PROFILE) of known mileage, as far as they decide for a subject that leaves out two.

        Each cell has a bound, the score of a sale with the profile's own mileage. Cells are
        read in rounds of falling bounds. A profile whose last score is above a cell's bound
        doesn't read that cell; one that has three tight matches, so one that isn't a subject's
        own, reads no cells but tight ones."""
        s, c = sides()
        known = profiles.filter("s_year IS NOT NULL AND s_class IS NOT NULL").withColumn("x_class", F.explode(F.array("s_class", F.lit(""))))
        reach = M.most_years_apart(F.col("s_year"), year, M.FAMILY)
        known = known.withColumns({"x_family": F.col("s_family"), "x_year": F.explode(F.sequence(F.col("s_year") - reach, F.col("s_year") + reach))}).join(self.families, CELL[:3])
        vague = profiles.filter("s_year IS NULL OR s_class IS NULL").withColumn("x_family", F.col("s_family")).join(self.families, "x_family")
        asked = self.asked(known.unionByName(vague), year, M.FAMILY)
        asked = written(asked.withColumns({"x_tight": M.kind_guards(s, c, year, M.TIGHT), "x_bound": M.match_score(s, c, 1.0, same_mileage=True)}).drop("c_class", "c_year", "c_condition", "c_operability"), "asked")
        # What lies next to a mileage is looked up once for all that ask the same cell about it.
        spots = [*CELL, "s_mileage"]
        near = self.by_family.sizes(self.by_family.places(asked.select(*spots).distinct(), _start()), self.reach, self.reach)
        near = near.groupBy(*spots).agg(F.collect_list(F.struct("c_mileage", "x_size")).alias("x_near"))
        placed = written(asked.join(near, spots), "places")
        found, have = None, None
        for low, high in zip(ROUNDS, [2.0, *ROUNDS]):
            part = placed.filter((F.col("x_bound") >= low) & (F.col("x_bound") < high))
            if found is not None:
                part = part.join(have, "s_id", "left").filter(
                    F.when(F.col("x_tight"), F.coalesce(F.col("x_bound") >= F.col("last_tight"), F.lit(True)))
                    .otherwise((F.coalesce("n_tight", F.lit(0)) < 3) & F.coalesce(F.col("x_bound") >= F.col("last_family"), F.lit(True)))
                ).drop(*have.columns[1:])
            part = part.withColumn("x_one", F.explode("x_near")).select(*[x for x in part.columns if x != "x_near"], "x_one.*")
            ring = self.valued(part, year, M.FAMILY, 1.0).select("s_id", *CELL, "c_mileage", "x_size", "tier", "score")
            found = enough(ring if found is None else found.unionByName(ring), ["s_id", "tier"], [F.desc("score")], self.reach).drop("x_better")
            found = written(found, "family-values")
            size = lambda tier: F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("x_size"))), F.lit(0))
            last = lambda tier: F.when(size(tier) >= self.reach, F.min(F.when(F.col("tier") == tier, F.col("score"))))
            have = found.groupBy("s_id").agg(size(M.TIGHT).alias("n_tight"), last(M.TIGHT).alias("last_tight"), last(M.FAMILY).alias("last_family"))
        decided = found.join(have.filter("n_tight >= 3").select("s_id", F.lit(True).alias("x_decided")), "s_id", "left").filter((F.col("tier") == M.TIGHT) | F.col("x_decided").isNull()).drop("x_decided")
        rows = self.with_cell(self.sold(decided, self.by_family))
        return _best(rows.select("s_id", *[f"c_{x}" for x in COMP], "tier", "score"), self.reach).drop("rank")

    def of_class(self, subjects: DataFrame, year: int, least: int, families: int) -> DataFrame:
        """The k best class matches of subjects (s_*) of known mileage that have ``least`` of
        them, in as many families as asked. Such subjects have no sale of their own family
        that passes: the family guards would have passed it."""
        reach = M.most_years_apart(F.col("s_year"), year, M.CLASS)
        asked = subjects.withColumns({"x_class": F.col("s_class"), "x_year": F.explode(F.sequence(F.col("s_year") - reach, F.col("s_year") + reach))})
        asked = written(asked, "class-left")
        cell_told = ["c_class", "c_year", "c_condition", "c_operability"]
        near = self.asked(asked.join(self.classes, ["x_class", "x_year"]), year, M.CLASS).drop(*cell_told)
        ring = self.found(self.by_class.places(near, _start()), self.by_class, year, M.CLASS, 0.58)
        found = written(_best(ring, max(self.k, least)), "class-matches")
        had = found.groupBy("s_id").agg(F.count(F.lit(1)).alias("x_n"), F.collect_set("c_family").alias("x_families")).filter(F.col("x_n") >= least)
        had = written(had, "class-counts")
        # Where the nearest are of too few families, others may lie farther off: one of each is enough.
        few = had.filter(F.size("x_families") < families).select("s_id")
        wide = self.asked(asked.join(few, "s_id").join(self.families, ["x_class", "x_year"]), year, M.CLASS).drop(*cell_told)
        rest = self.found(self.by_family.places(wide, _start()), self.by_family, year, M.CLASS, 0.58, reach=3)
        more = rest.groupBy("s_id").agg(F.collect_set("c_family").alias("x_more"))
        sure = had.join(more, "s_id", "left").filter(F.size(F.array_union("x_families", F.coalesce("x_more", F.array().cast("array<string>")))) >= families).select("s_id")
        return found.filter(F.col("rank") <= self.k).join(sure, "s_id", "left_semi")


def _searchable() -> Column:
    return F.coalesce(F.col("s_mileage") > 0, F.lit(False))


def _own_left_out(subjects: DataFrame, groups: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """subjects that have matches, with x_sales: the k best of the first tier that has any, after
    the subject's own auction and vehicle number are left out. matches: by the s_id of a group."""
    # Sorted by tier, then as _best() ranks.
    sale = F.struct("tier", (-F.col("score")).alias("x_score"), latest_first(F.col("c_ended_at")).alias("x_ended"), *[f"c_{x}" for x in COMP], "score")
    lists = matches.groupBy(F.col("s_id").alias("x_group")).agg(F.sort_array(F.collect_list(sale)).alias("x_all"))
    rows = handed_out(subjects, groups, lists, [f"s_{x}" for x in PROFILE])
    rows = rows.withColumn("x_all", F.filter("x_all", _strange)).filter(F.size("x_all") > 0)
    first = F.filter("x_all", lambda x: x["tier"] == F.col("x_all")[0]["tier"])
    return rows.select(*subjects.columns, F.slice(first, 1, k).alias("x_sales"))


def _strange(x: Column) -> Column:
    """not_self() of a struct beside s_*."""
    return ~x["c_auction_id"].eqNullSafe(F.col("s_external_id")) & ~F.coalesce(x["c_vin"] == F.col("s_vin"), F.lit(False))


def match_comparables(subjects: DataFrame, comps: DataFrame, as_of_year: int, *, k: int = 15, classes: list[str] | None = None, least: int = 3, families: int = 2) -> DataFrame:
    """The k best comparables of the first tier that has any: tight, family, then class."""
    s, c = sides()
    sales = Sales(written(latest_per_vin(comps), "latest-sales"), k)
    left = _renamed(subjects, SUBJECT, "s_").withColumn("s_mileage", F.col("s_mileage").cast("long"))
    in_family = left.filter("s_family IS NOT NULL")
    groups = grouped(in_family, [f"s_{x}" for x in PROFILE], "profiles")
    profiles = groups.drop("x_rows").withColumnRenamed("x_group", "s_id")
    searched = sales.of_family(profiles.filter(_searchable()), as_of_year)
    flat = _banded(profiles.filter(~_searchable()), sales.rows, as_of_year).filter(M.guards(s, c, as_of_year, M.FAMILY))
    flat = _best(flat.withColumns({"tier": _tier(as_of_year), "score": M.match_score(s, c, 1.0)}), sales.reach)
    taken = written(_own_left_out(in_family, groups, searched.unionByName(flat.select(*searched.columns)), k), "matches")
    family = taken.select(*left.columns, F.posexplode("x_sales").alias("rank", "x_sale")).select(*left.columns, *[F.col(f"x_sale.c_{x}") for x in COMP], "x_sale.tier", "x_sale.score", (F.col("rank") + 1).alias("rank"))

    rest = left.filter(F.col("s_class").isin(M.FALLBACK_CLASSES if classes is None else classes) & F.col("s_year").isNotNull()).join(taken.select("s_id"), "s_id", "left_anti").select(*left.columns)
    rest = written(rest, "rest")
    wider = sales.of_class(rest.filter(_searchable()), as_of_year, least, families)
    flat = _class_banded(rest.filter("s_mileage <= 0"), sales.rows, as_of_year).filter(not_self() & M.guards(s, c, as_of_year, M.CLASS))
    mine = Window.partitionBy("s_id")
    flat = flat.withColumn("x_enough", (F.count(F.lit(1)).over(mine) >= least) & (F.size(F.collect_set("c_family").over(mine)) >= families)).filter("x_enough").drop("x_enough")
    flat = _best(flat.withColumns({"tier": F.lit(M.CLASS), "score": M.match_score(s, c, 0.58)}), k)
    return family.unionByName(wider.select(*family.columns)).unionByName(flat.select(*family.columns))


def tier_counts(subjects: DataFrame, comps: DataFrame, as_of_year: int, classes: list[str] | None = None, *, least: int = 3, families: int = 2) -> DataFrame:
    """id, tier, candidates: the tier that each subject is valued by, and its size before any cut.

    Sales are counted by what the guards look at before they meet subjects; a subject's own
    auction and vehicle number are counted back."""
    s, c = sides()
    rows = _renamed(written(latest_per_vin(comps), "latest-sales"), COMP, "c_")
    kind = ["c_family", "c_class", "c_year", "c_condition", "c_operability"]
    counts = written(rows.groupBy(*kind, "c_mileage").agg(F.count(F.lit(1)).alias("n")), "counts")
    cells = written(counts.select(*kind).distinct().withColumn("x_cell", F.monotonically_increasing_id()), "count-cells")
    told = cells.select("x_cell", *[F.col(x).alias(f"x_{x}") for x in kind])
    counts = written(counts.join(told, [F.col(x).eqNullSafe(F.col(f"x_{x}")) for x in kind]).select("x_cell", "c_mileage", "n"), "cell-counts")
    left = _renamed(subjects, SUBJECT, "s_")
    own = left.join(rows.select(*kind, "c_mileage", "c_auction_id"), F.col("s_external_id") == F.col("c_auction_id"))
    same = left.join(rows.select(*kind, "c_mileage", "c_auction_id", "c_vin"), F.col("s_vin") == F.col("c_vin")).drop("c_vin")
    own = written(own.unionByName(same).dropDuplicates(["s_id", "c_auction_id"]), "own-sales")
    looks = [f"s_{x}" for x in PROFILE]

    def by_group(groups: DataFrame, banded, mode: int) -> DataFrame:
        """x_group, c_family, n (sales that pass the guards of the mode), n_tight (of them the tight
        guards). Guards look at the kind and at the mileage: what passes by mileage is counted
        once for all that ask the same cell with the same mileage."""
        asked = banded(groups.drop("x_rows").withColumnRenamed("x_group", "s_id"), cells, as_of_year).filter(M.kind_guards(s, c, as_of_year, mode))
        asked = written(asked.select("s_id", "c_family", "x_cell", "s_mileage", M.kind_guards(s, c, as_of_year, M.TIGHT).alias("x_tight")), "asked-cells")
        spots = asked.select("x_cell", "s_mileage").distinct().join(counts, "x_cell").filter(M.mileage_guard(s, c, mode))
        spots = spots.groupBy("x_cell", "s_mileage").agg(F.sum("n").alias("n"), F.sum(F.when(M.mileage_guard(s, c, M.TIGHT), F.col("n"))).alias("n_tight"))
        spots = spots.select(F.col("x_cell").alias("x_spot"), F.col("s_mileage").alias("x_mileage"), "n", "n_tight")
        pairs = asked.join(spots, (F.col("x_cell") == F.col("x_spot")) & F.col("s_mileage").eqNullSafe(F.col("x_mileage")))
        return pairs.groupBy(F.col("s_id").alias("x_group"), "c_family").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x_tight"), F.col("n_tight"))), F.lit(0)).alias("n_tight"))

    def told_to(rows: DataFrame, groups: DataFrame, told: DataFrame) -> DataFrame:
        """s_id, c_family, n, n_tight of each subject, its own sales among them."""
        groups = groups.join(told, "x_group").select(*[F.col(x).alias(f"x_of_{x}") for x in looks], "c_family", "n", "n_tight")
        return rows.join(groups, [F.col(x).eqNullSafe(F.col(f"x_of_{x}")) for x in looks]).select("s_id", "c_family", "n", "n_tight")

    less = lambda pairs, tight: pairs.select("s_id", "c_family", F.lit(-1).cast("long").alias("n"), F.when(tight, -1).otherwise(0).cast("long").alias("n_tight"))
    groups = grouped(left.filter("s_family IS NOT NULL"), looks, "profiles")
    mine = less(own.filter("s_family = c_family").filter(M.guards(s, c, as_of_year, M.FAMILY)), _tier(as_of_year) == M.TIGHT)
    found = told_to(left, groups, by_group(groups, _banded, M.FAMILY)).unionByName(mine).groupBy("s_id").agg(F.sum("n_tight").alias("tight"), F.sum("n").alias("all")).filter("all > 0")
    tight = F.col("tight") > 0
    found = written(found.select("s_id", F.when(tight, M.TIGHT).otherwise(M.FAMILY).alias("tier"), F.when(tight, F.col("tight")).otherwise(F.col("all")).alias("candidates")), "family-tiers")

    fallback = F.col("s_class").isin(M.FALLBACK_CLASSES if classes is None else classes) & F.col("s_year").isNotNull()
    rest = written(left.filter(fallback).join(found.select("s_id"), "s_id", "left_anti").select(*left.columns), "rest")
    groups = grouped(rest, looks, "rest-profiles")
    mine = less(own.filter("s_class = c_class").join(rest.select("s_id"), "s_id", "left_semi").filter(M.guards(s, c, as_of_year, M.CLASS)), F.lit(False))
    of_family = told_to(rest, groups, by_group(groups, _class_banded, M.CLASS)).unionByName(mine).groupBy("s_id", "c_family").agg(F.sum("n").alias("n")).filter("n > 0")
    wider = of_family.groupBy("s_id").agg(F.sum("n").alias("candidates"), F.count("c_family").alias("x_families")).filter((F.col("candidates") >= least) & (F.col("x_families") >= families))
    found = found.unionByName(wider.select("s_id", F.lit(M.CLASS).alias("tier"), "candidates")).withColumnRenamed("s_id", "id")
    return subjects.select("id").join(found, "id", "left").select("id", "tier", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def candidate_pool(subjects: DataFrame, comps: DataFrame, k: int = 200) -> DataFrame:
    """id, auction_id, by, rank: at most k near sales, of the family or else of the class.

    The year gap comes first in the order, so the years are taken from the subject's own
    outwards, and a subject that has k sales takes no part in wider gaps. Of a year it reads
    the sales next to its own mileage."""
    s, c = sides()
    sales = _renamed(comps.filter("year IS NOT NULL AND mileage IS NOT NULL"), ["auction_id", "family", "class", "year", "mileage", "vin", "ended_at"], "c_")
    sales = written(sales, "pool-sales")
    # A search passes over its own auction and all sales of its own vehicle number.
    own = sales.filter("c_vin IS NOT NULL").groupBy(F.col("c_vin").alias("vin")).agg(F.count(F.lit(1)).alias("n"))
    reach = k + 1 + (subjects.select("vin").join(own, "vin").agg(F.max("n")).first()[0] or 0)

    def near(subjects: DataFrame, key: str, years: int, least: float, share: float) -> DataFrame:
        """subjects (s_*) that have near sales, with x_sales: at most k, in order."""
        rows = sales.filter(f"c_{key} IS NOT NULL").select(F.col(f"c_{key}").alias("x_key"), F.col("c_year").alias("x_year"), "c_auction_id", "c_mileage", "c_vin", "c_ended_at")
        shelf = Shelf(rows, ["x_key", "x_year"], "c_mileage", [F.desc("c_ended_at"), "c_auction_id"], reach, block=64)
        asked = subjects.filter(s[key].isNotNull() & s["year"].isNotNull() & s["mileage"].isNotNull())
        looks = [f"s_{key}", "s_year", "s_mileage"]
        groups = grouped(asked, looks, f"pool-groups-{key}")  # all that a search looks at
        chosen, left = None, groups.withColumn("x_have", F.lit(0).cast("long"))
        gap = F.abs(s["mileage"] - c["mileage"])
        for apart in range(years + 1):
            at = F.array(s["year"] - apart, s["year"] + apart) if apart else F.array(s["year"])
            spots = left.select(s[key].alias("x_key"), F.explode(at).alias("x_year"), "x_group", "s_mileage", "x_have")
            values = shelf.sizes(shelf.places(spots, F.col("s_mileage")), reach, reach).withColumn("x_gap", gap).filter(F.col("x_gap") <= F.greatest(F.lit(least), s["mileage"] * share))
            ring = enough(values, ["x_group"], [F.col("x_gap")], F.lit(reach) - F.col("x_have"))
            ring = written(ring.select("x_group", "x_key", "x_year", "c_mileage", "x_size", F.lit(apart).alias("x_apart"), "x_gap"), f"pool-{key}")
            chosen = ring if chosen is None else chosen.unionByName(ring)
            if apart == years:
                break
            more = ring.groupBy("x_group").agg(F.sum("x_size").alias("x_more"))
            left = left.join(more, "x_group", "left").withColumn("x_have", F.col("x_have") + F.coalesce("x_more", F.lit(0))).drop("x_more").filter(F.col("x_have") < reach)
            left = written(left, "pool-left")
            if left.isEmpty():
                break
        order = Window.partitionBy("x_group").orderBy("x_apart", "x_gap", F.desc("c_ended_at"), "c_auction_id")
        first = unpacked(shelf.items(chosen)).withColumn("x_turn", F.row_number().over(order)).filter(F.col("x_turn") <= reach)
        lists = written(first.groupBy("x_group").agg(F.sort_array(F.collect_list(F.struct("x_turn", "c_auction_id", "c_vin"))).alias("x_all")), "pool-lists")
        found = handed_out(asked, groups, lists, looks).withColumn("x_sales", F.slice(F.filter("x_all", _strange), 1, k))
        return found.drop("x_all").filter(F.size("x_sales") > 0)

    def ranked(found: DataFrame, key: str) -> DataFrame:
        rows = found.select(F.col("s_id").alias("id"), F.posexplode(F.transform("x_sales", lambda x: x["c_auction_id"])).alias("x_at", "auction_id"))
        return rows.select("id", "auction_id", F.lit(key).alias("by"), (F.col("x_at") + 1).alias("rank"))

    left = written(_renamed(subjects, SUBJECT, "s_").select("s_id", "s_external_id", "s_vin", "s_family", "s_class", "s_year", "s_mileage"), "pool-subjects")
    family = near(left, "family", 5, 40_000.0, 0.75)
    rest = written(left.join(family.select("s_id"), "s_id", "left_anti"), "pool-rest")
    return ranked(family, "family").unionByName(ranked(near(rest, "class", 2, 15_000.0, 0.35), "class"))
