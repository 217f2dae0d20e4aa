"""Small corpora with the awkward cases."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "and", "thing", "été", "Straße", "alpha", "Beta", "gamma", "delta", "niño", "x1", "42", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, empties, nulls, repeats, one long text."""
    base, passage = prose(1, 120), prose(2, 70)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base), (2, base), (3, near), (4, prose(3, 40) + " " + passage + " " + prose(4, 30)), (5, passage + "\n" + prose(5, 10)), (6, ""), (7, None), (8, "one two"),
        (9, "one two"), (10, prose(6, 9000)), (11, prose(7, 200)), (11, prose(7, 200)), (12, "a" * 700), (13, "b" + "a" * 450), (None, base), (None, "only here"),
        (14, "  \t\n "), (15, prose(8, 49)), (16, prose(8, 49) + " end"), (17, passage), (18, "é" * 260), (19, "x" + "é" * 150),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def clashing(spark, rows):
    """The same with columns named like what operators use inside."""
    return frame(spark, rows).selectExpr("doc_id", "text", "doc_id AS x_id", "text AS x_text", "lang AS gram", "source AS bucket", "n_chars AS node", "'q' AS `odd.name`")
