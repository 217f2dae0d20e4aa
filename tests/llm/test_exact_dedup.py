import hashlib
from collections import defaultdict

from gavelflow.llm import exact_dedup, scratch
from tests.llm.helpers import clashing, corpus, frame


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        out.append((i, best, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def test_groups_match_plain_grouping(spark):
    rows = corpus()
    want, groups = expected(rows)
    for make in (frame, clashing):
        for digit in (1, 64):
            got = exact_dedup.duplicate_groups(make(spark, rows), first_digit=digit).collect()
            assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
            assert sum(r.kept for r in got) == groups
            assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_digit_boundaries(spark):
    rows = [(k, "q" * n) for k, n in enumerate([0, 1, 63, 64, 65, 64, 576, 575, 577, 576, 4672, 4672])]
    got = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect()}
    same = defaultdict(list)
    for i, t in rows:
        same[t].append(i)
    assert got == {i: max(same[t]) for i, t in rows}


def test_deduplicate_keeps_columns_and_one_row(spark):
    rows = corpus()
    docs = clashing(spark, rows)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert len(texts) == len(set(texts)) == expected(rows)[1]


def test_bit_tables_grow_with_the_groups(spark, tmp_path, monkeypatch):
    assert [exact_dedup.filter_bits(n) for n in (0, 1, 1 << 10, 1 << 17, 1 << 20, 1 << 40)] == [15, 15, 16, 23, 26, 26]
    docs = frame(spark, [(k, f"text {k // 2} of some pairs") for k in range(400)])
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    assert exact_dedup.deduplicate(docs).count() == 200
    rows = spark.read.parquet(str(next(tmp_path.glob("exact-dedup-*/marks0"))))
    assert sum(len(r.bits) for r in rows.collect()) == 4096  # some hundred rows of 4 KB where the table is of fixed size


def test_empty_table(spark):
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0
