import random
import re
import zlib
from hashlib import sha256

import pytest

from gavelflow.llm import prefix_trie
from gavelflow.llm.scratch import Scratch

TURNS = "conv_id long, turn long, role string, text string, key string, depth long, item string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "i") for r in rows], TURNS)


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows, rebuild=True):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = dict(turns)
    if rebuild:
        for c, own in turns.items():
            n = zlib.crc32(str(c).encode()) % 4
            base = turns.get(c - int(c - 20 * int(c / 20)), [])
            whole[c] = base[:n] + own[n:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, mine in members.items():
        under = [x for x in members if x[: len(node)] == node]
        child = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]  # noqa: B023, E731
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c in sorted(mine) if len(whole[c]) == len(node))
        out.append((min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(child(node)), sum(not child(x) for x in under), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, **sizes):
    return sorted(map(tuple, prefix_trie.rebuilt_trie(frame(spark, rows), **sizes).select(*COLUMNS).collect()), key=str)


def talks(seed, n, most=7, words=2):
    r = random.Random(seed)
    say = lambda: " ".join(r.choice(["yes", "no", "é", " x", "a\tb"]) for _ in range(r.randint(0, words)))
    return [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), say() or None) for c in r.sample(range(-30, 4 * n), n) for t in range(r.randint(1, most))]


def test_awkward_conversations(spark):
    rows = talks(1, 60) + [(None, 1, "user", "no conversation"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (9001, 0, "user", "alone"), (9002, 0, "a", "b"), (9003, 0, "a", "b")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("block,rulers,last", [(2, 2, 5), (4, 1000, 2)])
def test_small_blocks_and_every_level_of_the_ranking(spark, block, rulers, last):
    """One conversation and one first turn are shared by a third of all."""
    rows = talks(2, 40, most=5, words=1) + [(1000 + c, t, "user", f"same {t}") for c in range(25) for t in range(9)] + [(2000 + c, 0, "user", "same 0") for c in range(10)]
    rows += [(5000, t, "user", f"w {t % 3}") for t in range(40)]
    assert found(spark, rows, block=block, rulers=rulers, last=last) == plain(rows)


def test_tour_is_a_tour(spark):
    scratch = Scratch(spark, "trie-test")
    turns = prefix_trie.turns_of(frame(spark, talks(3, 50, words=1)), scratch)
    nodes = prefix_trie.trie(turns, prefix_trie.lengths_of(turns), scratch, block=3, rulers=2, last=10).collect()
    at = {(n.conv_id, n.depth): n for n in nodes}
    assert sorted([n.enter_at for n in nodes] + [n.exit_at for n in nodes]) == list(range(2 * len(nodes)))
    for n in nodes:
        if n.depth:
            p = at[n.parent_conv_id, n.depth - 1]
            assert p.enter_at < n.enter_at < n.exit_at < p.exit_at


def test_a_very_long_conversation_and_text(spark):
    rows = [(0, t, "user", "x y") for t in range(1500)] + [(c, t, "user", "x y") for c in (20, 40) for t in range(1400)] + [(60, 0, "user", "word " * 50_000)]
    got = {r[:2]: r for r in found(spark, rows)}
    assert len(got) >= 1500 and got[0, 1400][3] == 3 and got[0, 0][5] in (1, 2)
    assert got[0, 1401][6] == 0 and got[0, 1400][6] == 4
