"""Removal of passages that an earlier document holds, by suffix automata.

A word goes if a window of ``length`` words that covers it also starts in a document with
a smaller id. Reference shards are the groups of anchors.py: all windows that can be equal
lie under one anchor gram, and its different pieces, each with the smallest id that has it,
are the reference. A suffix automaton of the shard is grown in the order of ids while the
documents' pieces are streamed against it: matching statistics of ``length`` or more end a
maximal span that an earlier document holds, then the piece itself joins the automaton.

A gram with more than SHARD pieces has several shards, dealt by a hash; every piece of the
gram is streamed against each of them, in tasks of their own. So no automaton grows beyond
SHARD pieces, whatever the group, and all groups go the same way. Shards meet the pieces
that stream against them in a shuffle, rather than by broadcast: every shard against every
document would be work in the square of the corpus.

Equal stretches and equal pieces, such as the inside of a copied passage or a whole copied
document, reach an automaton once, for the first document that has them; a join on
(anchor gram, 128-bit digest) removes them from every later one.

Defined cases: null text has no words; a null id counts as larger than any other, so its
document loses what documents with ids hold and takes nothing from them; ids are whole numbers; rows with the
same id are one document; a text of fewer words keeps all; an empty table gives an empty
result; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import anchors as A
from gavelflow.llm import textkit as K
from gavelflow.llm.scratch import Scratch

NO_ID = (1 << 63) - 1
#: Different pieces of one shard's automaton.
SHARD = 200
#: Roles of a piece in a meeting: it is matched, it joins the automaton, or both.
STREAM, REFERENCE = 1, 2
#: Pieces that a task takes at a time, but for the last meeting's.
TOGETHER = 1_000


class SuffixAutomaton:
    """Of several sequences; a match never runs from one into the next."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list) -> None:
        last, step, link, size = 0, self.next, self.link, self.size
        for w in words:
            if w in step[last]:
                q = step[last][w]
                last = q if size[q] == size[last] + 1 else self._clone(last, w, q)
                continue
            new, p = len(size), last
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        step, link, size = self.next, self.link, self.size
        copy = len(size)
        step.append(dict(step[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def matched(self, words: list) -> list[int]:
        """At each word, the length of the longest match that ends there."""
        step, link, size = self.next, self.link, self.size
        at, long, out = 0, 0, []
        for w in words:
            while at and w not in step[at]:
                at = link[at]
                long = size[at]
            if w in step[at]:
                at = step[at][w]
                long += 1
            out.append(long)
        return out


def _later(rows: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of rows whose document comes after the first one with the same keys."""
    met = rows.join(first.select(*keys, F.col("x_id").alias("first_id")), keys).filter(F.coalesce("x_id", F.lit(NO_ID)) > F.coalesce("first_id", F.lit(NO_ID)))
    return met.select("x_id", "x_hash", "place", "windows")


def matched_spans(table: pa.Table, window: int) -> pa.RecordBatch:
    """Spans of the pieces that match an earlier one of their meeting. table: meeting (sorted),
    role, x_id, x_hash, place, windows, bytes."""
    data, start = K.text_bytes_of_binary(table.column("bytes"))
    meeting, role = np.asarray(table.column("meeting")), np.asarray(table.column("role"))
    ids = table.column("x_id").fill_null(NO_ID).to_pylist()
    edges = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1], [True]])).tolist() if len(meeting) else []
    places, rows = [], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        automaton, waiting, last = SuffixAutomaton(), [], None
        for r in sorted(range(lo, hi), key=ids.__getitem__):
            if ids[r] != last:
                for words in waiting:
                    automaton.add(words)
                waiting, last = [], ids[r]
            words = data[start[r] : start[r + 1]].tobytes().split(b" ")
            if role[r] & STREAM:
                for end, long in enumerate(automaton.matched(words)):
                    if long >= window:
                        places.append(end - window + 1)
                        rows.append(r)
            if role[r] & REFERENCE:
                waiting.append(words)
    return A.joined_windows(table, np.array(places, np.int64), np.array(rows, np.int64))


def _matched(known: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Spans of the different pieces of each gram that an earlier document holds."""
    several = known.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = scratch.save(several.select("gram", "shards"), "shards")
    dealt = known.join(several, "gram").withColumn("shard", F.pmod(F.xxhash64("piece"), F.col("shards")).cast("int"))
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    # Meeting (i, j): shard i's automaton, and the pieces of shard j streamed against it.
    as_reference = F.transform(every, lambda j: F.struct(F.col("shard").alias("i"), j.alias("j"), F.when(F.col("shard") == j, STREAM | REFERENCE).otherwise(REFERENCE).alias("role")))
    as_stream = F.transform(F.filter(every, lambda i: i != F.col("shard")), lambda i: F.struct(i.alias("i"), F.col("shard").alias("j"), F.lit(STREAM).alias("role")))
    met = dealt.withColumn("m", F.explode(F.concat(as_reference, as_stream)))
    rows = met.select(F.xxhash64("gram", "m.i", "m.j").alias("meeting"), "m.role", "x_id", "x_hash", "place", "windows", "bytes")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            meeting = np.asarray(table.column("meeting"))
            cut = int(np.searchsorted(meeting, meeting[-1]))
            if cut:
                yield matched_spans(table.slice(0, cut), window)
                held = table.slice(cut).to_batches()
        if held:
            yield matched_spans(pa.Table.from_batches(held), window)

    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(of, "x_id long, x_hash long, place long, windows int")


def _spans(repeats: A.Repeats, scheme: A.Scheme) -> DataFrame:
    scratch = repeats.scratch
    known = repeats.stretches.select("gram", "stretch", "n", "different", "x_id", "x_hash", "place", "windows", "anchor")
    # A document after the first one that has the stretch loses all of it.
    later = _later(repeats.runs, known.filter("n > 1"), ["gram", "stretch"])
    # The first one loses the windows that other stretches, of smaller ids, hold.
    mixed = known.filter("different > 1").select("x_id", "x_hash", "place", "windows", "gram", "anchor")
    parts = scratch.save(A.with_text(repeats, mixed, scheme, "gram long, anchor int"), "parts")
    scratch.drop("wanted")
    pieces = scratch.save(A.pieces(repeats, parts, scheme, ""), "pieces")
    scratch.drop("parts")
    least = F.min(F.struct(F.col("x_id").isNull().alias("none"), "x_id", "x_hash", "place", "windows")).alias("first")
    first = pieces.groupBy("gram", "piece").agg(least, F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
    first = scratch.save(first.select("gram", "piece", "n", "first.*", "bytes"), "first-pieces")
    met = scratch.save(_matched(first, scratch, scheme.window), "matched")
    places = _at_other_places(pieces, first.filter("n > 1"), ["gram", "piece"], met)
    # What a stretch loses, it loses at all its places in that document.
    found = scratch.save(_later(pieces, first.filter("n > 1"), ["gram", "piece"]).unionByName(met).unionByName(places), "found")
    again = _at_other_places(repeats.runs, known.filter("n > 1 AND different > 1"), ["gram", "stretch"], found)
    return later.unionByName(found).unionByName(again)


def _at_other_places(rows: DataFrame, first: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """The found spans of each first row, at the other rows of its document with the same keys."""
    first = first.select(*keys, F.col("x_id").alias("f_id"), F.col("x_hash").alias("f_hash"), F.col("place").alias("f_place"), F.col("windows").alias("f_windows"))
    others = rows.join(first, keys).filter(F.col("x_id").eqNullSafe(F.col("f_id")) & ((F.col("place") != F.col("f_place")) | (F.col("x_hash") != F.col("f_hash"))))
    others = others.select("x_id", "x_hash", "place", "f_id", "f_hash", "f_place", "f_windows")
    lost = found.select(F.col("x_id").alias("l_id"), F.col("x_hash").alias("l_hash"), F.col("place").alias("l_place"), F.col("windows").alias("l_windows"))
    same = F.col("f_id").eqNullSafe(F.col("l_id")) & (F.col("f_hash") == F.col("l_hash"))
    inside = (F.col("l_place") >= F.col("f_place")) & (F.col("l_place") < F.col("f_place") + F.col("f_windows"))
    met = others.join(lost, same & inside)
    return met.select("x_id", "x_hash", (F.col("place") + F.col("l_place") - F.col("f_place")).alias("place"), F.col("l_windows").alias("windows"))


def _parts(units: A.Units, gone: np.ndarray, joined) -> list:
    out = []
    for a, b in zip(units.first[:-1].tolist(), units.first[1:].tolist(), strict=True):
        part = units.data[units.at[a] : units.end[b - 1]] if b > a else units.data[:0]
        if gone[a:b].any():
            words = part.tobytes().split(b" ")
            text = b" ".join([w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g])
        else:
            text = part.tobytes()
        out.append(joined(text))
    return out


def _removed(ids: pa.Array, units: A.Units, gone: np.ndarray) -> pa.RecordBatch:
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    digest = _parts(units, gone, lambda text: hashlib.sha256(text).hexdigest())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(units.first)), pa.array(np.diff(total[units.first])), pa.array(digest, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    scheme = A.Scheme("word", length, max(1, min(8, length // 2)))
    repeats = A.find(docs, scheme, Scratch(docs.sparkSession, "substring-dedup"), id_col, text_col)
    return A.covered_texts(repeats, _spans(repeats, scheme), scheme, _removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(ids: pa.Array, units: A.Units, gone: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(_parts(units, gone, lambda text: text.decode()), pa.string())], names=["doc_id", "kept"])


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id and kept, the remaining words joined by single blanks."""
    scheme = A.Scheme("word", length, max(1, min(8, length // 2)))
    repeats = A.find(docs, scheme, Scratch(docs.sparkSession, "substring-dedup"), id_col, text_col)
    return A.covered_texts(repeats, _spans(repeats, scheme), scheme, _kept, "doc_id long, kept string")
