"""The values that resolve_in_one() chooses from are found beside each other."""

import threading

from gavelflow.plans import market_queries


def test_three_values_are_found_at_once(spark, monkeypatch):
    """Each waits until the others have begun: one after the other, they waited for ever."""
    begun, ids = threading.Barrier(3, timeout=60), [f"s{k}" for k in range(6)]

    def value(columns, rows):
        def found(spark, sf_dir):
            begun.wait()
            return spark.createDataFrame(rows, columns)

        return found

    monkeypatch.setattr(market_queries, "_subjects", lambda spark, sf_dir: spark.createDataFrame([(x,) for x in ids], "id string"))
    monkeypatch.setattr(market_queries, "value_subjects", value("id string, status string, median_cents long, confidence double", [("s0", "available", 10, 0.9), ("s1", "available", 11, 0.1), ("s2", "unavailable", None, 0.0)]))
    monkeypatch.setattr(market_queries, "exact_identity_valuation", value("id string, median_cents long, sample_size long", [("s0", 20, 5), ("s1", 21, 5), ("s3", 23, 1)]))
    monkeypatch.setattr(market_queries, "market_offer_valuation", value("id string, median_cents long, sample_size long", [("s3", 33, 30), ("s4", 34, 1), ("s2", 32, 5)]))
    got = {x.id: (x.source, x.median_cents) for x in market_queries.resolve_in_one(spark, "").collect()}
    assert got == {"s0": ("bundled", 10), "s1": ("exact", 21), "s2": ("cache", 32), "s3": ("offers", 33), "s4": ("negative-cache", None), "s5": ("unavailable", None)}
