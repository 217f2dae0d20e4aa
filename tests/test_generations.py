"""Publishing that survives failed, repeated and interrupted builds; point lookups."""

import shutil

import pytest
from pyspark.sql import functions as F

from gavelflow.sources.generations import Generations, lookup

BOARD = "id string, external_id string, score int"


def board(spark, n, score=1):
    return spark.range(n).select(F.format_string("lot-%06d", "id").alias("id"), F.md5(F.col("id").cast("string").cast("binary")).alias("external_id"), F.lit(score).alias("score"))


def scores(g, spark):
    found = g.read(board(spark, 1).schema, F.timestamp_seconds(F.lit(0)))
    return None if found is None else {tuple(x) for x in found.groupBy("score").count().collect()}


def test_a_refused_build_takes_nothing_away(spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    assert g.publish(board(spark, 5), "g1", "2024-01-01 00:00:00") == 5
    for broken in (board(spark, 3, 2).unionByName(board(spark, 3, 3)), board(spark, 0), board(spark, 9).withColumn("id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            g.publish(broken, "g2", "2024-01-01 01:00:00")
    with pytest.raises(ValueError):
        g.publish(board(spark, 9), "g2", "2024-01-01 01:00:00", most_rows=8)
    assert scores(g, spark) == {(1, 5)} and len(list((tmp_path / "rows").iterdir())) == 1


def test_an_id_is_taken_once(spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    g.publish(board(spark, 5, 1), "g1", "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        g.publish(board(spark, 6, 2), "g1", "2024-01-01 02:00:00")
    # Two at once: the entry of the other one is there when this one wants to take the id.
    (tmp_path / "manifest" / "of=g2").mkdir()
    g._there, there = (lambda name: name != "manifest/of=g2" and there(name)), g._there
    with pytest.raises(Exception):
        g.publish(board(spark, 6, 3), "g2", "2024-01-01 02:00:00")
    g._there = there
    assert scores(g, spark) == {(1, 5)} and g.manifest().count() == 1
    assert len(list((tmp_path / "rows").iterdir())) == 1


def test_reading_falls_back_and_an_empty_root_is_nothing(spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    assert scores(g, spark) is None
    for k in (1, 2, 3):
        g.publish(board(spark, 4 + k, k), f"g{k}", f"2024-01-01 0{k}:00:00")
    assert g.manifest().count() == 2 and scores(g, spark) == {(3, 7)}
    newest = g.manifest().orderBy(F.desc("generated_at")).first().build
    shutil.rmtree(tmp_path / "rows" / newest)
    assert scores(g, spark) == {(2, 6)}


def test_a_build_that_died_is_removed_when_old(spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    board(spark, 3).write.parquet(str(tmp_path / "rows" / "died"))
    g.publish(board(spark, 5), "g1", "2024-01-01 00:00:00")
    assert (tmp_path / "rows" / "died").exists()
    g.retire(orphan_hours=-1)
    assert not (tmp_path / "rows" / "died").exists() and scores(g, spark) == {(1, 5)}


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    n = 60_000
    g.publish(board(spark, n), "g1", "2024-01-01 00:00:00", block_bytes=200_000)
    rows = g.read(board(spark, 1).schema, F.timestamp_seconds(F.lit(0)))
    lot = rows.filter("id = 'lot-000777'").first()
    for ident in (lot.id, lot.external_id, "lot-nothing"):
        found = lookup(rows, ident)
        assert [r.id for r in found.collect()] == ([lot.id] if ident != "lot-nothing" else [])
        scan = found._jdf.queryExecution()
        found._jdf.collect()
        leaves = scan.executedPlan().collectLeaves()
        read = leaves.apply(0).metrics().get("numOutputRows").get().value()
        assert read < n / 4
