"""Merkle manifest of a dataset, with octopus multiproofs.

Each row is a leaf: the SHA-256 of its fields. Each language has a tree over its leaves by
id; the languages' roots are the leaves of the top tree. Parents are hashed from two
consecutive nodes, the last from one where the number is odd.

A tree is built in rounds: a task takes BLOCK consecutive nodes and hashes ten levels
above them; what it leaves goes to the next round. A billion leaves take three rounds.

Proofs are made by block of leaves. A block works out which node coordinates lie on no path
of its own leaves but beside one (the octopus set: each missing node once, however many
leaves need it), one join fetches them for all blocks, and the block derives the nodes that
its leaves share and reads each leaf's own siblings from both. A block fetches about one
node for each level above it, not one for each leaf and level.

Defined cases: a null field is "-" in the leaf; a null language is a tree of its own, the
first; null ids come first; rows of equal id lie in order of their leaves, equal rows side
by side; ids may be texts (then order is by bytes); an empty table has no rows and no root;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.ordering import ranked
from gavelflow.llm.scratch import Scratch

#: Nodes of one task's subtree, a power of two.
BLOCK = 1024
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The tree over the languages' roots; languages are numbered from 0.
TOP = -1
NODE = "tree long, level int, at long, digest string"


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n leaves: 0 for a lone leaf."""
    return max(n - 1, 0).bit_length()


def size_at(n: int, level: int) -> int:
    return -(-n >> level) if level else n


def missing(level: int, places: Iterable[int], n: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the fewest nodes that the given ones (of one level) need to reach the root of n leaves."""
    here = sorted(set(places))
    while size_at(n, level) > 1:
        known = set(here)
        yield from ((level, p ^ 1) for p in here if p ^ 1 not in known and p ^ 1 < size_at(n, level))
        here = sorted({p >> 1 for p in here})
        level += 1


def derived(nodes: dict[tuple[int, int], str], places: Iterable[int], n: int) -> None:
    """Adds to nodes all that lies above the given leaves of a tree of n leaves, each once."""
    here, level = sorted(set(places)), 0
    while size_at(n, level) > 1:
        here = sorted({p >> 1 for p in here})
        for p in here:
            nodes[level + 1, p] = digest(nodes[level, 2 * p], nodes.get((level, 2 * p + 1), ""))
        level += 1


def siblings(nodes: dict[tuple[int, int], str], place: int, n: int) -> list[tuple[str, bool]]:
    """Level by level, the other node of the place's run, if any, else "", and whether it comes first."""
    path = []
    for level in range(levels_of(n)):
        p = place >> level
        path.append((nodes.get((level, p ^ 1), ""), bool(p & 1)))
    return path


def folded(leaf: str, path: list[tuple[str, bool]]) -> str:
    for other, first in path:
        leaf = digest(other, leaf) if first else digest(leaf, other)
    return leaf


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(list(column), kind) for (name, kind), column in zip(kinds.items(), columns)})


def _subtree(nodes: pa.Table, height: int) -> pa.Table:
    """Levels above up to 2**height consecutive nodes of one tree: tree, level, at, digest, n (nodes of the level in the tree)."""
    nodes = nodes.sort_by("at")
    tree, level, n, first = (nodes[c][0].as_py() for c in ("tree", "level", "n", "at"))
    here, out = nodes["digest"].to_pylist(), []
    for _ in range(height):
        if n == 1:
            break
        here = [digest(*here[i : i + 2]) for i in range(0, len(here), 2)]
        level, first, n = level + 1, first >> 1, (n + 1) >> 1
        out += [(tree, level, first + i, h, n) for i, h in enumerate(here)]
    return _table(out, tree=pa.int64(), level=pa.int32(), at=pa.int64(), digest=pa.string(), n=pa.int64())


def built(leaves: DataFrame, scratch: Scratch, name: str, height: int) -> DataFrame:
    """All nodes of all trees, so many levels a round. leaves: tree, at, digest, n (leaves of the tree)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    base = leaves.select("tree", F.lit(0).alias("level"), "at", "digest", "n")
    nodes, level = base.select("tree", "level", "at", "digest"), 0
    while size_at(most, level) > 1:
        block = F.shiftright("at", height).alias("block")
        above = base.filter("n > 1").groupBy("tree", block).applyInArrow(lambda nodes: _subtree(nodes, height), NODE + ", n long")
        level += height
        above = scratch.save(above, f"{name}{level}")
        nodes = nodes.unionByName(above.select("tree", "level", "at", "digest"))
        base = above.filter(F.col("level") == level)
    return nodes


class Manifest:
    """leaves: doc_id, leaf, tampered, tree, at, n. nodes: tree, level, at, digest. trees: lang, tree, n."""

    def __init__(self, docs: DataFrame, tampering: Column | None = None, *, fields: list[str] = FIELDS, id_col: str = "doc_id", lang_col: str = "lang", count_col: str = "n_chars", block: int = BLOCK):
        """tampering says of which rows a copy with one added to count_col is to be proved; block, a
        power of two, how many consecutive leaves a task proves."""
        self.spark, self.height = docs.sparkSession, levels_of(block)
        self.scratch = scratch = Scratch(self.spark, "merkle")
        col = {c: F.col(f"`{c}`") for c in {*fields, id_col, lang_col, count_col}}
        more = F.coalesce((col[count_col].try_cast("decimal(38,0)") + 1).cast("string"), col[count_col].cast("string"))
        changed = {**col, count_col: more}
        leaf = leaf_of(*[col[c] for c in fields])
        forged = leaf_of(*[changed[c] for c in fields])
        rows = docs.select(col[id_col].alias("doc_id"), col[lang_col].alias("lang"), leaf.alias("leaf"), (F.lit(None).cast("string") if tampering is None else F.when(tampering, forged)).alias("tampered"))
        rows = scratch.save(rows, "rows")
        sizes = scratch.save(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
        self.trees = scratch.save(ranked(sizes, [], ["lang"], scratch, "langs").withColumnRenamed("x_rank", "tree"), "trees")
        self.n_trees = self.trees.count()
        placed = ranked(rows, ["lang"], ["doc_id", "leaf"], scratch, "order").withColumnRenamed("x_rank", "at")
        trees = self.trees.select(F.col("lang").alias("of_lang"), "tree", "n")
        self.leaves = scratch.save(placed.join(trees, F.col("lang").eqNullSafe(F.col("of_lang"))).drop("lang", "of_lang"), "leaves")
        below = built(self.leaves.select("tree", "at", F.col("leaf").alias("digest"), "n"), scratch, "level", self.height)
        tops = self.trees.select("tree", "n", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).alias("level"), F.lit(0).cast("long").alias("at"))
        self.subroots = scratch.save(below.join(tops, ["tree", "level", "at"]).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(self.n_trees).cast("long").alias("n")), "subroots")
        self.nodes = below.unionByName(built(self.subroots, scratch, "top", self.height))

    def root(self) -> str | None:
        found = self.nodes.filter((F.col("tree") == TOP) & (F.col("level") == levels_of(self.n_trees))).first()
        return found.digest if found else None

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the wanted rows of
        leaves (default: all), a row for each."""
        wanted = self.leaves if wanted is None else wanted
        shift, n_trees = self.height, self.n_trees
        block = F.shiftright("at", shift).alias("block")

        def needs(leaves: pa.Table) -> pa.Table:
            places = leaves["at"].to_pylist()
            tree, n, b = leaves["tree"][0].as_py(), leaves["n"][0].as_py(), places[0] >> shift
            want = [(tree, *c) for c in missing(0, places, n)] + [(TOP, *c) for c in missing(0, [tree], n_trees)]
            want += [(tree, levels_of(n), 0), (TOP, levels_of(n_trees), 0)]  # what the proofs are held against
            return _table([(tree, b, *w) for w in want], of_tree=pa.int64(), of_block=pa.int64(), tree=pa.int64(), level=pa.int32(), at=pa.int64())

        def proved(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
            out = []
            if len(leaves):
                tree, n, places = leaves["tree"][0].as_py(), leaves["n"][0].as_py(), leaves["at"].to_pylist()
                digests = leaves["leaf"].to_pylist()
                own, top = {(0, at): leaf for at, leaf in zip(places, digests)}, {}
                for t, level, at, h in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "at", "digest"))):
                    (top if t == TOP else own)[level, at] = h
                subroot, root = own[levels_of(n), 0], top[levels_of(n_trees), 0]
                derived(own, places, n)
                above = siblings(top, tree, n_trees)
                for doc_id, leaf, forged, at in zip(leaves["doc_id"].to_pylist(), digests, leaves["tampered"].to_pylist(), places):
                    path = siblings(own, at, n) + above
                    reached = folded(forged or leaf, path)
                    out.append((doc_id, leaf, subroot, root, digest(*[other for other, _ in path]), reached, reached == root))
            text = pa.string()
            return _table(out, doc_id=text, leaf=text, subroot=text, root=text, proof_sha256=text, folded_root=text, verified=pa.bool_())

        asked = wanted.select("tree", "at", "n").groupBy("tree", block).applyInArrow(needs, "of_tree long, of_block long, tree long, level int, at long")
        fetched = self.scratch.save(asked.join(self.nodes, ["tree", "level", "at"]), "fetched")
        kind = self.leaves.schema["doc_id"].dataType.simpleString()
        left = wanted.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", block)
        found = left.cogroup(fetched.groupBy("of_tree", "of_block")).applyInArrow(proved, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def tampered_by_id(id_col: str = "doc_id") -> Column:
    """Where 7 divides the CRC-32 of the id's decimal form; never of a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 0, F.lit(False))
