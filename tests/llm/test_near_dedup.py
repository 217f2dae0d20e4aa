import itertools
import re
from collections import Counter

import numpy as np

from gavelflow.llm import near_dedup
from gavelflow.llm import textkit as K
from tests.llm.helpers import clashing, corpus, frame, prose


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for a, b in itertools.combinations(range(n), 2):
        both = sum((sets[a] & sets[b]).values())
        if (rows[a][1] or "") == (rows[b][1] or "") or (both and both >= 0.8 * sum((sets[a] | sets[b]).values())):
            root[find(a)] = find(b)
    out = {}
    for k in range(n):
        out.setdefault(find(k), []).append(k)
    named = [None] * n
    for ids in out.values():
        least = min((rows[k][0] for k in ids if rows[k][0] is not None), default=None)
        for k in ids:
            named[k] = (rows[k][0], least, len(ids))
    return named


def family(seed, n):
    words = prose(seed, 150).split(" ")
    out = []
    for k in range(n):
        w = list(words)
        for j in range(k % 5):
            w[(17 * k + 31 * j) % 150] = f"edit{k}x{j}"
        out.append(" ".join(w))
    return out


def test_classes_match_brute_force(spark, monkeypatch):
    rows = corpus() + [(100 + k, t) for k, t in enumerate(family(50, 40))] + [(200 + k, prose(60, 80) + " " + prose(61 + k, 10)) for k in range(8)]
    want = sorted(brute_classes(rows), key=str)
    for make, block in ((frame, 2_000), (clashing, 7)):  # the second deals families over many blocks
        monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", block)
        got = near_dedup.classes(make(spark, rows)).collect()
        assert sorted([(r.doc_id, r.class_id, r.class_size) for r in got], key=str) == want


def test_deduplicate_keeps_the_smallest_of_each_class(spark):
    rows = corpus()
    docs = clashing(spark, rows)
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    classes = {(c, n) if c is not None else (i, n) for i, c, n in brute_classes(rows)}
    assert got.count() == len({c for c, _ in classes if c is not None}) + len([1 for i, c, _ in brute_classes(rows) if c is None])
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted({c for c, _ in classes if c is not None})


def test_empty_table(spark):
    assert near_dedup.classes(frame(spark, [])).count() == 0


def test_signatures_are_unbiased():
    r = np.random.default_rng(5)
    e = K.mixed(np.arange(1, 300, dtype=np.uint64))
    a = r.integers(1, 40, len(e))
    b = np.where(r.random(len(e)) < 0.5, a, r.integers(1, 40, len(e)))
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = near_dedup.bag_min_hash(np.repeat([0, 1], len(e)), np.concatenate([e, e]), np.concatenate([a, b]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - truth) < 5 * (truth * (1 - truth) / 4096) ** 0.5


def test_links_beyond_the_first_ties(spark, monkeypatch):
    """Without any first ties all links come from open texts held against their family, in blocks."""
    monkeypatch.setattr(near_dedup, "FIRST_TIES", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 9)
    rows = corpus() + [(100 + k, t) for k, t in enumerate(family(50, 40))]
    got = near_dedup.classes(clashing(spark, rows)).collect()
    assert sorted([(r.doc_id, r.class_id, r.class_size) for r in got], key=str) == sorted(brute_classes(rows), key=str)


def test_slices_change_nothing():
    import pyarrow as pa

    texts = [prose(k, 40_000) for k in range(3)] + ["", "one two", prose(5, 30)]
    raw, offsets = K.text_bytes(pa.array(texts))
    row, h, count = near_dedup.multisets(raw, offsets)
    for k, t in enumerate(texts):
        assert sorted(count[row == k].tolist()) == sorted(shingles(t).values())
        alone = near_dedup.multisets(*K.text_bytes(pa.array([t])))
        assert (alone[1] == h[row == k]).all() and (alone[2] == count[row == k]).all()
