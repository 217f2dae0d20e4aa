"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document's ids are those of the tokenizer followed by the end id. Only documents
longer than a sequence are cut, into full pieces and a last, shorter one. Pieces are
placed one by one: of all open residual gaps, and a new sequence, the choice is the one
after which the sum over gaps of (number of open sequences with that gap) squared is
smallest. That keeps gaps of every size few, so that later pieces still find their fit.

Pieces are dealt over shards by a hash of their saved row numbers, so no key can heat one,
and each shard packs about ``shard_pieces`` of them, in every round. Sequences that a
shard leaves with more than ``slack`` of room are opened again and their pieces dealt anew,
round by round, until one bounded shard holds what is left, or until a round leaves more
than seven eighths of its pieces over: then its sequences stay as they are.

Defined cases: null text counts as empty and is the end id alone; every row is packed,
repeated rows too, each under its own doc_id (a null doc_id stays null); an empty table
gives an empty result; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.scratch import Scratch
from gavelflow.llm.tokens import SLICE_BYTES, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_ids(raw: np.ndarray, offsets: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents with the end id after each, length of each)."""
    ids, each = encoder(path).encode(raw, offsets)
    out = np.full(len(ids) + len(each), end_id, np.dtype("<u4"))
    out[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
    return out, each + 1


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column(1))
            for lo, hi in K.slices(offsets, SLICE_BYTES):
                ids, each = document_ids(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tokenizer, end_id)
                pieces = -(-each // capacity)
                piece = K.gathered(pieces, np.zeros(hi - lo, np.int64))
                start = piece * capacity
                length = np.minimum(np.repeat(each, pieces) - start, capacity)
                at = np.repeat(np.cumsum(each) - each, pieces) + start
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), pieces)))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(of, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; 0 is closed
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        # Filling gap g makes N[g] one less and N[g - size] one more: 2 (N[g - size] - N[g] + 1) on the
        # sum. A closed sequence counts for nothing: 1 - 2 N[size]. A new one: 2 N[capacity - size] + 1.
        change = 2 * (count[: capacity - size + 1] - count[size:] + 1)
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())  # on ties the fullest
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if change[best] == np.iinfo(np.int64).max or fresh < change[best]:
            gap, place = capacity, made
            made += 1
        else:
            gap = best + size
            place = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = place, capacity - gap
        rest = gap - size
        if rest:
            open_at[rest].append(place)
            count[rest] += 1
    return sequence, offset


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    shard_pieces: int = 32_768,
    slack: int = 8,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    left = scratch.save(cut_into_pieces(narrow, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = [c.split()[0] for c in PIECES.split(", ")]
    schema = f"{PIECES}, row long, sequence_id long, offset long, room long"

    def packed(level: int):
        def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
            lengths = rows["length"].to_numpy()
            sequence, offset = sum_of_squares(lengths, capacity)
            room = capacity - np.bincount(sequence, weights=lengths).astype(np.int64)
            return rows.drop(columns="shard").assign(sequence_id=(level << 56) + (int(key[0]) << 24) + sequence, offset=offset, room=room[sequence])

        return of

    done, level, pieces = [], 0, left.count()
    while True:
        shards = max(1, -(-pieces // shard_pieces))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        placed = scratch.save(dealt.groupBy("shard").applyInPandas(packed(level), schema), f"placed{level}")
        rest = placed.filter(F.col("room") > slack)
        over = rest.count() if shards > 1 else 0
        if shards == 1 or over * 8 > pieces * 7:
            done.append(placed)
            break
        done.append(placed.filter(F.col("room") <= slack))
        left, pieces, level = rest.select(*columns, "row"), over, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("room", "row")
