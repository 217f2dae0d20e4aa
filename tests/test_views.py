"""Shared views hold every row of their tables; queries over them give every part its result."""

import datetime as dt
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from gavelflow.plans.bindings import view

PARTS = [(k, f"Brand#{k % 3}", ["SMALL TIN", "LARGE BRASS"][k % 2], 1 + k % 50) for k in range(1, 61)]
LINES = [(k, n, 1 + (k * 7 + n) % 60, 1 + k % 4, 1.0 + (k + n) % 50, 1000.0 + 10 * k + n, "ANR"[k % 3], "OF"[n % 2], dt.date(1995 + k % 7, 1 + n, 5)) for k in range(1, 41) for n in range(1, 8)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (
        ("part", PARTS, "p_partkey long, p_brand string, p_type string, p_size int"),
        ("lineitem", LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date"),
        ("supplier", [(k, k % 2) for k in range(1, 5)], "s_suppkey long, s_nationkey int"),
        ("nation", [(0, "A"), (1, "B")], "n_nationkey int, n_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def test_views_hold_all_rows(spark, folder):
    assert {r.external_id for r in view(spark, folder, "subjects").collect()} == {str(k) for k, *_ in PARTS}
    assert sorted(r.seen for r in view(spark, folder, "outcomes").collect()) == sorted(k * 10 + n for k, n, *_ in LINES)
    assert view(spark, folder, "offers").count() == len(LINES)


@pytest.mark.parametrize("name", ["value_subjects", "match_tiers", "resolve_valuation"])
def test_every_part_has_its_row(spark, folder, name):
    assert sorted(r.id for r in entry.queries()[name](spark, folder).collect()) == sorted(f"lot:{k}" for k, *_ in PARTS)


def test_offers_of_all_lines_count(spark, folder):
    part = {k: (brand, kind) for k, brand, kind, _ in PARTS}
    offers = defaultdict(list)
    for _, _, key, _, _, _, _, _, day in LINES:
        offers[part[key][0], day.year].append(part[key][1].lower())
    want = {}
    for k, brand, kind, _ in PARTS:
        of = offers[brand, 1995 + k % 7]
        fits = sum(kind[:3].lower() in t for t in of)
        if of:
            want[f"lot:{k}"] = fits if fits >= 3 else len(of)
    assert {r.id: r.sample_size for r in entry.queries()["market_offer_valuation"](spark, folder).collect()} == want
