import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gavelflow.llm import merkle

from .helpers import DOCS, clashing

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def climbed(nodes, at):
    """Root of the nodes, and the siblings of one with the side they stand on."""
    path = []
    while len(nodes) > 1:
        run = nodes[at & ~1 : (at & ~1) + 2]
        path.append((run[1 - at % 2] if len(run) == 2 else "", at % 2))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    leaves = {x: [leaf(r) for r in trees[x]] for x in langs}
    subroots = [climbed(leaves[x], 0)[0] for x in langs]
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(trees[x]):
            subroot, path = climbed(leaves[x], at)
            root, above = climbed(subroots, k)
            forged = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                forged["n_chars"] += 1
            fold = leaf(forged)
            for other, first in path + above:
                fold = h(other, fold) if first else h(fold, other)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[o for o, _ in path + above]), fold, fold == root))
    return sorted(out, key=str)


def documents(n, langs, seed=3):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "a b", "é" * 40, None, "x" * 3000]), r.choice(langs), r.choice(["web", None]), r.choice([None, 0, i, 2**63 - 1])) for i in r.sample(range(-50, 5 * n), n)]
    return rows + rows[:3] + [(rows[0][0], "other text", rows[0][2], "web", 1), (None, "no id", "en", "web", 2), (None, None, None, None, None)]


def proved(docs, **more):
    return merkle.Manifest(docs, merkle.tampered_by_id(), **more).proofs()


@pytest.mark.parametrize("langs", [["en"], ["en", None, "de", "é", "EN"], [f"l{i}" for i in range(11)]])
def test_against_plain_trees(spark, langs):
    docs = spark.createDataFrame(documents(150, langs), DOCS)
    want = plain([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, proved(docs, block=8).collect()), key=str) == want  # several rounds, and blocks with siblings outside
    assert {False, True} == {x[-1] for x in want}


def test_single_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(0, "only", "en", "web", 4)], DOCS)
    assert [tuple(x) for x in proved(one).collect()] == plain([one.first().asDict()])
    none = merkle.Manifest(one.filter("false"))
    assert none.proofs().collect() == [] and none.root() is None


def test_columns_of_other_names_and_text_ids(spark):
    docs = clashing(spark, [(i, f"t{i}") for i in range(20)]).selectExpr("cast(doc_id as string) AS doc_id", "text", "gram AS lang", "bucket AS source", "'7' AS n_chars", "x_id", "x_text AS x_part", "1 AS tree", "2 AS at", "`odd.name`")
    found = merkle.Manifest(docs, F.col("doc_id") == "3").proofs().collect()
    assert sorted(r.doc_id for r in found) == sorted(map(str, range(20))) and [r.doc_id for r in found if not r.verified] == ["3"]


def test_proofs_of_some_leaves_fetch_each_missing_node_once(spark):
    manifest = merkle.Manifest(spark.createDataFrame(documents(300, ["en", "de"]), DOCS), block=16)
    every = {r.leaf: r.proof_sha256 for r in manifest.proofs().collect()}
    some = manifest.proofs(manifest.leaves.filter("at % 10 < 3")).collect()
    assert some and all(r.verified and every[r.leaf] == r.proof_sha256 for r in some)
    # Leaves 2, 3 and 6 of 8 need no sibling 2 or 3 and one node for both 2 and 3 above.
    assert sorted(merkle.missing(0, [2, 3, 6], 8)) == [(0, 7), (1, 0), (1, 2)]
    assert sorted(merkle.missing(0, [4], 5)) == [(2, 0)]
    n, places = 1000, random.Random(1).sample(range(1000), 200)
    assert len(list(merkle.missing(0, places, n))) < 200 * merkle.levels_of(n) / 3
