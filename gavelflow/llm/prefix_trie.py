"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. It is named (conv_id, depth) after the
smallest conversation that begins with it; the nodes with one conv_id form a path down.

* Keys of sequences: turns are taken in blocks of BLOCK; within a block SHA-256 digests are
  chained, and the digests of whole blocks are chained in the same way, so that a
  conversation of any length is dealt to many tasks and equal sequences get equal keys.
* Euler tour: each node has an enter and an exit arc. enter(v) goes on to the enter arc of
  v's first child, else to exit(v); exit(v) goes on to the enter arc of v's next sibling,
  else to the exit arc of v's parent. Children are ordered by conv_id.
* List ranking: arcs that follow each other within BLOCK depths of one path are first summed
  to one item of the list (down: enter arcs; up: exit arcs until one whose node has a next
  sibling). The items are ranked by pointer jumping to randomly chosen rulers (one in
  RULERS), the list of rulers in the same way, until at most LAST items are left, which one
  task walks. Each item then knows the sum of weights from it to the tour's end.
* Subtree sums: the sums from enter(v) on less the sums from exit(v) on. Weights lie on
  enter arcs: 1 for a childless node, and the tokens that sharing the node's turn saves.

Defined cases: turns are ordered by turn (null first), those of one turn by the digest of role
and text; null role or text is empty; rows without conv_id belong to no conversation and are left out; a conversation
whose turns are all taken away still ends at the root; repeated rows are turns of their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.llm.ordering import ranked
from gavelflow.llm.scratch import Scratch

BLOCK = 256
#: One item in RULERS is a ruler; at most LAST items are walked by one task.
RULERS, LAST = 8, 4096
#: Conversation ids that are joined to one string before they meet others of their node.
IDS = 256
WORD = r"[^\x20\x09-\x0D]+"
SUMS = ["arcs", "leaves", "saved"]


def turns_of(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 0), digest (of role and text), words."""
    said = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text")}
    rows = messages.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.sha2(F.concat(F.octet_length(said["role"]).cast("string"), F.lit(":"), said["role"], said["text"]).cast("binary"), 256).alias("digest"),
        F.regexp_count(said["text"], F.lit(WORD)).cast("long").alias("words"),
    )
    placed = ranked(rows, ["conv_id"], ["turn", "digest"], scratch, "turns")
    return scratch.save(placed.select("conv_id", F.col("x_rank").alias("place"), "digest", "words"), "placed")


def lengths_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def rebuilt(turns: DataFrame, scratch: Scratch, *, run: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """turns and lengths of conversations that begin with the first h turns of the one that
    begins their run of ids, h being the CRC-32 of the id modulo ``most``."""
    sizes = scratch.save(lengths_of(turns), "sizes")
    convs = sizes.withColumns({"base": F.expr(f"conv_id - conv_id % {run}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    convs = convs.join(sizes.withColumnsRenamed({"conv_id": "base", "n_turns": "n_base"}), "base", "left")
    given = F.least("h", F.coalesce("n_base", F.lit(0))).cast("long")
    convs = scratch.save(convs.select("conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns")), "rebuilt")
    openings = turns.filter((F.col("place") < most) & (F.col("conv_id") % run == 0)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(openings, "base").filter("place < h").select("conv_id", "place", "digest", "words")
    own = turns.join(convs.select("conv_id", "h", "given"), "conv_id").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "digest", "words")
    return first.unionByName(own), convs.select("conv_id", "n_turns")


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def prefix_keys(turns: DataFrame, scratch: Scratch, block: int = BLOCK, name: str = "keys") -> DataFrame:
    """turns (conv_id, place, digest, words), key (of the turns up to this) and before (of
    those before it; null at the first). Equal sequences, and only they, have equal keys."""
    number = F.floor(F.col("place") / block).cast("long")
    rows = F.array_sort(F.collect_list(F.struct("place", "digest", "words")))  # at most `block` rows
    chain = F.aggregate("rows", F.array().cast("array<string>"), lambda done, row: F.concat(done, F.array(_sha(F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), row["digest"]))))
    blocks = scratch.save(turns.groupBy("conv_id", number.alias("block")).agg(rows.alias("rows")).withColumn("chain", chain), name)
    if blocks.filter("block > 0").isEmpty():
        blocks = blocks.withColumns({"carried": F.lit(None).cast("string"), "last": F.lit(None).cast("string")})
    else:
        whole = blocks.filter(F.size("rows") == block).select("conv_id", F.col("block").alias("place"), F.get("chain", F.size("chain") - 1).alias("digest"), F.lit(0).cast("long").alias("words"))
        up = prefix_keys(whole, scratch, block, name + "-up")
        last = F.when(F.col("before").isNull(), F.col("digest")).otherwise(_sha(F.col("before"), F.col("digest")))
        up = up.select("conv_id", (F.col("place") + 1).alias("block"), F.col("key").alias("carried"), last.alias("last"))
        blocks = blocks.join(up, ["conv_id", "block"], "left")
    each = blocks.select("conv_id", "carried", "last", "chain", F.posexplode("rows").alias("at", "row"))
    key = lambda inside: F.when(F.col("carried").isNull(), inside).otherwise(_sha(F.col("carried"), inside))
    before = F.when(F.col("at") == 0, F.col("last")).otherwise(key(F.get("chain", F.col("at") - 1)))
    return each.select("conv_id", "row.*", key(F.get("chain", F.col("at"))).alias("key"), before.alias("before"))


def _streamed_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, key, ends_sha256 of rows (depth, key, ids) that come sorted by depth, key and order of ids."""
    now, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if at[:2] != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = at[:2], sha256()
            else:
                state.update(b",")
            state.update(at[2].encode())
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    if now is not None:
        out.append((*now, state.hexdigest()))
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    depth, key, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(key, pa.string()), pa.array(digest, pa.string())], ["depth", "key", "ends_sha256"])


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """depth, key, ends_sha256 for ends: depth, key, conv_id. A digest is taken by one task
    that reads its node's ids as a stream, IDS to a row; it keeps none of them."""
    ends = scratch.save(ends, "ends")
    placed = ranked(ends, ["depth", "key"], ["conv_id"], scratch, "ends-placed")
    ids = placed.groupBy("depth", "key", F.floor(F.col("x_rank") / IDS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return ids.repartition("depth", "key").sortWithinPartitions("depth", "key", "part").select("depth", "key", "ids").mapInArrow(_streamed_sha, "depth long, key string, ends_sha256 string")


def node_table(turns: DataFrame, convs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, words, ends_sha256."""
    keyed = prefix_keys(turns, scratch, block)
    rows = keyed.select("conv_id", (F.col("place") + 1).alias("depth"), "key", F.coalesce("before", F.lit("")).alias("parent_key"), "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("long").alias("words"))
    rows = scratch.save(rows.unionByName(root), "rows")
    nodes = rows.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("parent_key").alias("parent_key"))
    nodes = scratch.save(nodes, "nodes")
    ends = rows.select("conv_id", "depth", "key").join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"])
    digests = end_digests(ends, scratch)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(parents, ["depth", "parent_key"], "left").join(digests, ["depth", "key"], "left")
    nothing = F.lit(sha256().hexdigest())
    return scratch.save(named.select("conv_id", "depth", "parent_conv_id", "n_convs", "words", F.coalesce("ends_sha256", nothing).alias("ends_sha256")), "named")


def _walked(frame: pd.DataFrame) -> pd.DataFrame:
    """The list of a bounded number of items, from its end."""
    rows = {r[0]: r[1:] for r in frame[["item", "next", *SUMS]].itertuples(index=False)}
    (end,) = (k for k, r in rows.items() if r[0] not in rows)
    before = {r[0]: k for k, r in rows.items()}
    sums, out, k = [0] * len(SUMS), [], end
    while k is not None:
        sums = [a + b for a, b in zip(sums, rows[k][1:])]
        out.append((k, *sums))
        k = before.get(k)
    return pd.DataFrame(out, columns=["item", *SUMS])


def list_sums(items: DataFrame, scratch: Scratch, *, rulers: int = RULERS, last: int = LAST, level: int = 0) -> DataFrame:
    """item and, of each sum, the total from the item to the list's end, itself included.
    items: item, next (null at the end) and the sums; read from a table."""
    if items.count() <= last:
        return items.groupBy().applyInPandas(_walked, "item string, arcs long, leaves long, saved long")
    ruler = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(rulers)) == 0
    ended = F.col("next").isNull() | ruler(F.col("next"))
    # next: how far the item has come; the sums are of all items from it up to there.
    reached, waiting, k = [items.filter(ended)], items.filter(~ended), 0
    while not waiting.isEmpty():
        there = waiting
        for part in reached:
            there = there.unionByName(part)
        there = there.select(F.col("item").alias("next"), F.col("next").alias("after"), *[F.col(c).alias(f"{c}_there") for c in SUMS])
        jumped = waiting.join(there, "next").select("item", F.col("after").alias("next"), *[(F.col(c) + F.col(f"{c}_there")).alias(c) for c in SUMS])
        jumped = scratch.save(jumped, f"list{level}-{k}")
        reached, waiting, k = [*reached, jumped.filter(ended)], jumped.filter(~ended), k + 1
    state = reached[0]
    for part in reached[1:]:
        state = state.unionByName(part)
    state = scratch.save(state, f"list{level}")
    for done in range(k):
        scratch.drop(f"list{level}-{done}")
    marks = list_sums(scratch.save(state.filter(ruler(F.col("item"))), f"rulers{level}"), scratch, rulers=rulers, last=last, level=level + 1)
    marks = marks.select(F.col("item").alias("next"), *[F.col(c).alias(f"{c}_there") for c in SUMS])
    return state.join(marks, "next", "left").select("item", *[(F.col(c) + F.coalesce(f"{c}_there", F.lit(0))).alias(c) for c in SUMS])


def _down(conv: str, depth: Column, block: int) -> Column:
    return F.concat_ws(":", F.lit("down"), conv, F.floor(depth / block).cast("long"))


def _up(conv: str, depth: Column) -> Column:
    return F.concat_ws(":", F.lit("up"), conv, depth)


def subtree_sums(nodes: DataFrame, scratch: Scratch, *, block: int = BLOCK, rulers: int = RULERS, last: int = LAST) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, n_convs, words, ...) and n_children, n_leaves,
    saved_tokens, and enter_at, exit_at: the places of the node's arcs in the tour, from 0."""
    depth = F.col("depth")
    born = nodes.filter("parent_conv_id IS NOT NULL").select("parent_conv_id", "depth", "conv_id")
    turn = scratch.save(ranked(born, ["parent_conv_id", "depth"], ["conv_id"], scratch, "siblings"), "turns-of-siblings")
    after = turn.select("parent_conv_id", "depth", (F.col("x_rank") - 1).alias("x_rank"), F.col("conv_id").alias("next_sibling"))
    next_of = turn.join(after, ["parent_conv_id", "depth", "x_rank"]).select("conv_id", "depth", "next_sibling")
    children = born.groupBy(F.col("parent_conv_id").alias("conv_id"), (depth - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    tree = nodes.join(next_of, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    tree = tree.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("words"), "segment": F.floor(depth / block).cast("long")})

    here = Window.partitionBy("conv_id", "segment")  # at most `block` rows
    downwards, upwards = here.orderBy("depth"), here.orderBy(F.desc("depth"))
    earlier = downwards.rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{c}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for c, v in (("arcs", F.lit(1)), ("leaves", F.col("leaf")), ("saved", F.col("saving")))}
    below = F.lead("depth").over(downwards)
    begins = below.isNull() | F.lead("next_sibling").over(downwards).isNotNull()
    tree = tree.withColumns({**before, "bottom": below.isNull(), "begins": begins})
    tree = tree.withColumn("up_from", F.last(F.when(F.col("begins"), depth), ignorenulls=True).over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    tree = scratch.save(tree.withColumns({"down": _down("conv_id", depth, block), "up": _up("conv_id", F.col("up_from"))}), "tree")

    turned = F.when(F.col("n_children") > 0, _down("first_child", depth + 1, block)).otherwise(F.col("up"))
    down = tree.filter("bottom").select(F.col("down").alias("item"), turned.alias("next"), (F.col("arcs_before") + 1).alias("arcs"), (F.col("leaves_before") + F.col("leaf")).alias("leaves"), (F.col("saved_before") + F.col("saving")).alias("saved"))
    onward = F.when(F.col("next_sibling").isNotNull(), _down("next_sibling", depth, block)).when(F.col("parent_conv_id").isNotNull(), _up("parent_conv_id", depth - 1))
    ends = F.col("parent_conv_id").isNull() | F.col("next_sibling").isNotNull() | (F.col("parent_conv_id") != F.col("conv_id")) | (depth % block == 0)
    zero = F.lit(0).cast("long")
    up = tree.filter(ends).select(F.col("up").alias("item"), onward.alias("next"), (F.col("up_from") - depth + 1).alias("arcs"), zero.alias("leaves"), zero.alias("saved"))
    sums = scratch.save(list_sums(scratch.save(down.unionByName(up), "items"), scratch, rulers=rulers, last=last), "sums")

    enter = sums.select(F.col("item").alias("down"), *[F.col(c).alias(f"{c}_enter") for c in SUMS])
    leave = sums.select(F.col("item").alias("up"), *[F.col(c).alias(f"{c}_exit") for c in SUMS])
    total = 2 * nodes.count()
    of = lambda c: F.col(f"{c}_enter") - F.col(f"{c}_before") - F.col(f"{c}_exit")
    return tree.join(enter, "down").join(leave, "up").select(
        *nodes.columns, "n_children", of("leaves").alias("n_leaves"), of("saved").alias("saved_tokens"),
        (F.lit(total) - F.col("arcs_enter") + F.col("arcs_before")).alias("enter_at"),
        (F.lit(total) - F.col("arcs_exit") + F.col("up_from") - depth).alias("exit_at"),
    )


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch, **sizes: int) -> DataFrame:
    """The trie's nodes with all sums. turns: conv_id, place, digest, words; lengths: conv_id, n_turns."""
    nodes = node_table(turns, lengths, scratch, sizes.get("block", BLOCK))
    return subtree_sums(nodes, scratch, **sizes)


def rebuilt_trie(messages: DataFrame, **sizes: int) -> DataFrame:
    """The trie of conversations after ``rebuilt``."""
    scratch = Scratch(messages.sparkSession, "prefix-trie")
    turns, lengths = rebuilt(turns_of(messages, scratch), scratch)
    return trie(turns, lengths, scratch, **sizes)
