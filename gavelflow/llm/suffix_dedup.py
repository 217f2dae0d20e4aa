"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``length`` bytes only, by most-significant-digit
passes; a group that is left after the last pass is a string of that length that starts at
several places. The digits are those of anchors.py: the first two stand for whole runs of
neighbouring suffixes, so that a corpus of n bytes deals out about n / 85 records instead
of n suffixes; the next ones narrow down the different stretches of a gram. The last two
decide: pieces that are equal as a whole, and the single suffixes of those that aren't, in
both cases by 128-bit digests of the bytes.

All strings are judged on the input, and every copy goes, the first one too.

Defined cases: null text counts as empty; texts shorter than ``length`` bytes keep all;
rows that repeat are copies of each other; ids are whole numbers, and may repeat or be null; an empty table
gives an empty result; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import anchors as A
from gavelflow.llm import textkit as K
from gavelflow.llm.scratch import Scratch


def _spans(repeats: A.Repeats, scheme: A.Scheme) -> DataFrame:
    """x_id, x_hash, place, windows of the repeated strings."""
    scratch = repeats.scratch
    whole = repeats.runs.join(repeats.stretches.filter("n > 1").select("gram", "stretch"), ["gram", "stretch"])
    whole = whole.select("x_id", "x_hash", "place", "windows")
    mixed = repeats.stretches.filter("different > 1").select("x_id", "x_hash", "place", "windows", "gram", "anchor", "n")
    parts = scratch.save(A.with_text(repeats, mixed, scheme, "gram long, anchor int, n long"), "parts")
    scratch.drop("wanted")
    pieces = scratch.save(A.pieces(repeats, parts, scheme, "n long"), "pieces")
    scratch.drop("parts")
    by_piece = pieces.groupBy("gram", "piece").agg(F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"), F.min(F.struct("n", "x_id", "x_hash", "place", "windows")).alias("one"))
    by_piece = scratch.save(by_piece.select("gram", "copies", "one.*", "piece", "bytes"), "by-piece")
    # Equal pieces are repeated throughout; where a whole stretch is repeated (n > 1), nothing is left to find.
    same = pieces.filter("n = 1").join(by_piece.filter("copies > 1").select("gram", "piece"), ["gram", "piece"])
    same = same.select("x_id", "x_hash", "place", "windows")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.text_bytes_of_binary(batch.column("bytes"))
            windows = np.asarray(batch.column("windows"))
            first = K.gathered(windows, at[:-1])
            row = np.repeat(np.arange(len(windows)), windows)
            view = memoryview(np.ascontiguousarray(data))
            digest = [xxhash.xxh3_128_digest(view[a : a + scheme.window]) for a in first.tolist()]
            pick, place = pa.array(row), np.asarray(batch.column("place"))[row] + first - at[row]
            columns = [batch.column(c).take(pick) for c in ("gram", "x_id", "x_hash", "n", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(digest, pa.binary())], names=["gram", "x_id", "x_hash", "n", "copies", "place", "digest"])

    last = by_piece.mapInArrow(suffixes, "gram long, x_id long, x_hash long, n long, copies long, place long, digest binary")
    last = scratch.save(last, "suffixes")
    twice = scratch.save(last.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > 1).select("gram", "digest"), "twice")
    rest = last.filter("n = 1 AND copies = 1").join(twice, ["gram", "digest"]).select("x_id", "x_hash", "place", F.lit(1).alias("windows"))
    return whole.unionByName(same).unionByName(rest)


def _removed(ids: pa.Array, units: A.Units, gone: np.ndarray) -> pa.RecordBatch:
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    spans = np.bincount(K.runs(gone, units.first)[2], minlength=len(ids))
    digest = []
    for a, b in zip(units.first[:-1].tolist(), units.first[1:].tolist(), strict=True):
        part = units.data[a:b]
        digest.append(hashlib.sha256(part[~gone[a:b]].tobytes() if total[b] > total[a] else part.tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(units.first)), pa.array(np.diff(total[units.first])), pa.array(spans.astype(np.int64)), pa.array(digest, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scheme = A.Scheme("byte", length, max(1, min(32, length // 2)))
    repeats = A.find(docs, scheme, Scratch(docs.sparkSession, "suffix-dedup"), id_col, text_col)
    return A.covered_texts(repeats, _spans(repeats, scheme), scheme, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept(ids: pa.Array, units: A.Units, gone: np.ndarray) -> pa.RecordBatch:
    kept = [units.data[a:b][~gone[a:b]].tobytes() for a, b in zip(units.first[:-1].tolist(), units.first[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary())], names=["doc_id", "kept"])


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """doc_id and kept, the remaining bytes: a cut may fall inside a character."""
    scheme = A.Scheme("byte", length, max(1, min(32, length // 2)))
    repeats = A.find(docs, scheme, Scratch(docs.sparkSession, "suffix-dedup"), id_col, text_col)
    return A.covered_texts(repeats, _spans(repeats, scheme), scheme, _kept, "doc_id long, kept binary")
