"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is ``window`` consecutive words (the whole item where it has
fewer). As a set of word shingles it is contained in a text only if all its shingles
are, so of its shingles, ordered by rarity over all documents, the first one is the
necessary prefix: a text without it can't hold the window. The join runs on these
prefix tokens alone. A match at word p puts the window's start at p minus the token's
place in the window (positional bound), which must leave room for the whole window in
the text (length bound); then the window's words are compared one by one, so a result
never rests on a hash.

The benchmark is the stated query set. It is taken in blocks of bounded bytes (or of one
item), one at a time: a block is made, broadcast and run against all documents, whose rows
with what was found are written, and let go before the next. A larger benchmark means more
blocks, not more memory.

Defined cases: null text has no words; an item without words has no window, one without an id counts under the empty id; several
items with the same window all count; an empty table of documents gives an empty result
and an empty benchmark leaves all clean; repeated rows are scored alike; extra columns
are ignored (``decontaminate`` keeps them), whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.scratch import Scratch

#: Words of a shingle, or all words of a shorter window.
SHINGLE = 5
#: Bytes of benchmark text in a block: some 200,000 windows at most, about 100 MB of dictionaries.
BLOCK_BYTES = 1 << 20


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, row) of the words."""
    low = K.ASCII_LOWER[raw]
    return low, *K.runs(K.ALNUM[low], offsets)


def shingle_hashes(word: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """A hash of words i to i + size of one row; windows that cross rows get 0."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * K.BASE + word[j : n + j]
    out = K.mixed(out + np.uint64(size)) | np.uint64(1)
    out[row[:n] != row[size - 1 :]] = 0
    return out


class Windows:
    """The windows of a block of items, and their shingles."""

    def __init__(self, ids: list, texts: list[str], window: int):
        self.of: dict[bytes, tuple[int, list]] = {}  # words joined by a space: how many, items
        for item, text in zip(ids, texts, strict=True):
            raw, offsets = K.text_bytes(pa.array([text], pa.string()))
            low, start, end, _ = words_of(raw, offsets)
            words = [low[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                items = self.of.setdefault(b" ".join(words[i : i + size]), (size, []))[1]
                if not items or items[-1] != item:
                    items.append(item)
        self.keys = sorted(self.of)
        sizes = np.array([self.of[k][0] for k in self.keys], np.int64)
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for size in sorted({*np.minimum(sizes, SHINGLE).tolist()}):
            held = [w for w in range(len(self.keys)) if min(sizes[w], SHINGLE) == size]
            raw, offsets = K.text_bytes(pa.array([self.keys[w].decode() for w in held]))
            low, start, end, row = words_of(raw, offsets)
            h = shingle_hashes(K.span_hashes(K.prefix_sums(low), start, end), row, size)
            first = np.searchsorted(row, np.arange(len(held)))
            by: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for i in np.flatnonzero(h).tolist():
                by[int(h[i])].append((held[row[i]], i - int(first[row[i]])))
            places[size] = dict(by)
        #: size: {shingle: [(window, place of the shingle in it)]}
        self.places = places

    def vocabulary(self) -> dict[int, np.ndarray]:
        return {size: np.array(sorted(by), np.uint64) for size, by in self.places.items()}

    def prefixes(self, seen: dict[int, int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Like places, with each window only under its rarest shingle."""
        best: dict[int, tuple] = {}
        for size, by in self.places.items():
            for h, where in by.items():
                for w, place in where:
                    best[w] = min(best.get(w, (1 << 62,)), (seen.get(h, 0), h, place, size))
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for w, (_, h, place, size) in best.items():
            out.setdefault(size, {}).setdefault(h, []).append((w, place))
        return out


def _hits(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where h has one of the sorted wanted values; a table of bits turns most away."""
    bits = np.zeros(1 << 16, bool)
    bits[(wanted >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, h[maybe]), len(wanted) - 1)
    return maybe[wanted[at] == h[maybe]]


def _rarity(docs: DataFrame, vocabulary: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each shingle of the block stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column(0))
            for lo, hi in K.slices(offsets):
                low, start, end, row = words_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                word = K.span_hashes(K.prefix_sums(low), start, end)
                for size, wanted in vocabulary.items():
                    h = shingle_hashes(word, row, size)
                    for x, n in zip(*(a.tolist() for a in np.unique(h[_hits(h, wanted)], return_counts=True)), strict=True):
                        total[x] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([*total], np.uint64).view(np.int64)), pa.array([*total.values()], pa.int64())], names=["h", "n"])

    found = docs.select("x_text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r.h % (1 << 64): r.n for r in found.collect()}  # a row for each shingle of the block at most


def _scan(docs: DataFrame, block, columns: list[str]) -> DataFrame:
    """Adds what a block finds to x_spans (word ranges) and x_items (ids as strings)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, items_of, prefixes = block.value
        wanted = {size: np.array(sorted(by), np.uint64) for size, by in prefixes.items()}
        for batch in batches:
            raw_all, offsets_all = K.text_bytes(batch.column(columns.index("x_text")))
            n_words, spans_out, items_out = [], [], []
            old_spans = batch.column(columns.index("x_spans"))
            old_items = batch.column(columns.index("x_items"))
            for lo, hi in K.slices(offsets_all):
                raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
                low, start, end, row = words_of(raw, offsets)
                word = K.span_hashes(K.prefix_sums(low), start, end)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                spans: dict[int, list[int]] = defaultdict(list)
                items: dict[int, set[str]] = defaultdict(set)
                for size, by in prefixes.items():
                    h = shingle_hashes(word, row, size)
                    for i in _hits(h, wanted[size]).tolist():
                        r = int(row[i])
                        for w, place in by[int(h[i])]:
                            words, at = items_of[w][0], i - place
                            if at < first[r] or at + words > first[r + 1]:
                                continue
                            if all(low[start[at + j] : end[at + j]].tobytes() == x for j, x in enumerate(keys[w])):
                                spans[r] += [at - int(first[r]), at - int(first[r]) + words]
                                items[r].update(items_of[w][1])
                n_words.append(np.diff(first))
                spans_out += [spans.get(r, []) for r in range(hi - lo)]
                items_out += [sorted(items.get(r, ())) for r in range(hi - lo)]
            spans_out = [a + b for a, b in zip(old_spans.to_pylist(), spans_out, strict=True)]
            items_out = [a + b for a, b in zip(old_items.to_pylist(), items_out, strict=True)]
            new = {
                "x_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                "x_spans": pa.array(spans_out, pa.list_(pa.int32())),
                "x_items": pa.array(items_out, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(columns)], names=columns)

    return docs.select(*columns).mapInArrow(scan, docs.select(*columns).schema)


def _blocks(items: DataFrame, blocks: int, window: int) -> Iterator[Windows]:
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = part.collect()  # one block of bounded bytes
        found = Windows([r.item for r in rows], [r.text for r in rows], window)
        if found.keys:
            yield found


def find(docs: DataFrame, benchmark: DataFrame, carry: dict, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """carry columns, x_words, x_spans (starts and ends of hit word ranges, in turn), x_items."""
    spark = docs.sparkSession
    out = docs.select(
        *[c.alias(name) for name, c in carry.items()],
        F.col(text_col).cast("string").alias("x_text"),
        F.lit(0).cast("long").alias("x_words"),
        F.array().cast("array<int>").alias("x_spans"),
        F.array().cast("array<string>").alias("x_items"),
    )
    columns, source = out.columns, out
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    scratch, held, k = Scratch(spark, "decontamination"), None, 0
    for block in _blocks(items, blocks, window):
        if held is not None:  # what the block before found is written before its broadcast goes
            out = scratch.save(out, f"block{k}")
            held.destroy()
            if k > 1:
                scratch.drop(f"block{k - 1}")
        seen = _rarity(source, block.vocabulary())
        items_of = [block.of[key] for key in block.keys]
        held = spark.sparkContext.broadcast(([key.split(b" ") for key in block.keys], items_of, block.prefixes(seen)))
        out, k = _scan(out, held, columns), k + 1
    if held is None:
        out = _scan(out, spark.sparkContext.broadcast(([], [], {})), columns)
    return out.drop("x_text")


def _hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            hit: set[int] = set()
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                hit.update(range(a, b))
            names = sorted({*items})
            n_hit.append(len(hit))
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = find(docs, benchmark, {"doc_id": F.col(id_col)}, text_col=text_col, window=window)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_hit, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    carry = {f"x_{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}
    found = find(docs, benchmark, carry, text_col=text_col, window=window)
    return found.filter(F.size("x_spans") == 0).select(*[F.col(f"x_{k}").alias(c) for k, c in enumerate(docs.columns)])
