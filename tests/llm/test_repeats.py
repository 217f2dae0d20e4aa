import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from gavelflow.llm import substring_dedup, suffix_dedup
from tests.llm.helpers import clashing, corpus, frame, prose


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length):
    big = float("inf")
    texts = [(big if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = defaultdict(lambda: big)
    for o, _, w in texts:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first[key], o)
    out = []
    for o, i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < o:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_passages():
    """Passages cut and pasted at random, within and across documents."""
    r = random.Random(3)
    pool = [prose(100 + k, 90).split(" ") for k in range(6)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(pool)
            a = r.randrange(60)
            words += p[a : a + r.randrange(20, 80)] + [f"own{i}w{r.randrange(9)}"] * r.randrange(3)
        rows.append((r.randrange(1000), " ".join(words)))
    return [*rows, *corpus()]


def test_bytes_match_brute_force(spark):
    rows = shared_passages()
    for length, make in ((200, frame), (60, clashing)):
        got = suffix_dedup.removals(make(spark, rows), length=length).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_bytes(rows, length)


@pytest.mark.parametrize("shard", [1_000, 2])
def test_words_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)  # the second deals grams over many shards
    rows = shared_passages()
    for length, make in ((50, frame), (12, clashing)):
        got = substring_dedup.removals(make(spark, rows), length=length).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_words(rows, length)


def test_one_hot_passage_and_repeated_rows(spark):
    """A passage in thousands of different surroundings, one text a thousand times, and a long text."""
    passage = prose(77, 60)
    rows = [(k, f"{prose(k, 3)} own{k} {passage} tail{k} {prose(k + 1, 3)}") for k in range(3_000)]
    rows += [(5_000, prose(8, 120))] * 1_000 + [(6_000, prose(9, 60_000) + " " + passage)]
    got = suffix_dedup.removals(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_bytes(rows, 200)
    got = substring_dedup.removals(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_words(rows, 50)


def test_texts_that_stay(spark):
    rows = [(1, prose(1, 60) + " Tail end"), (2, "Head " + prose(1, 60)), (3, None)]
    got = {r.doc_id: r.kept for r in substring_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Head", 3: ""}
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got == {1: b" Tail end", 2: b"Head ", 3: b""}


def test_empty_tables(spark):
    assert suffix_dedup.removals(frame(spark, [])).count() == 0
    assert substring_dedup.removals(frame(spark, [])).count() == 0


def test_automaton_matches_plain_search():
    r = random.Random(1)
    automaton, held = substring_dedup.SuffixAutomaton(), []
    for _ in range(30):
        words = [r.choice("abc") for _ in range(r.randrange(1, 25))]
        want = []
        for end in range(len(words)):
            best = 0
            for h in held:
                for n in range(end + 1, best, -1):
                    part = words[end + 1 - n : end + 1]
                    if any(h[k : k + n] == part for k in range(len(h) - n + 1)):
                        best = n
                        break
            want.append(best)
        assert automaton.matched(words) == want
        automaton.add(words)
        held.append(words)
