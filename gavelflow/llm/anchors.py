"""Repeated windows over a corpus, found through content-defined anchors.

A window is a fixed number of consecutive units (bytes or words) of one text. Its anchor
is the gram of ``gram`` units in it whose hash is smallest (the first on ties). Equal
windows have equal anchors at equal places, so windows can only be equal within the group
of one anchor gram. Neighbouring windows mostly share their anchor, so a text is a short
list of runs: an anchor, and the windows that own it, whose units are one stretch of text.

Digits sort the windows, most significant first, and a group of one drops out at each:

1. the anchor gram: a gram that stands once in the corpus ends its run, whose windows are
   all unique;
2. the whole stretch of a run: runs with equal stretches have equal windows throughout, and
   one of them stands for all from here on;
3. among the different stretches of one gram, the core: a stretch's windows are cut into
   SEGMENTS by the anchor's place in them, and the windows of a segment share their middle;
4. the window itself. Neighbouring windows that still are not alone are a piece;
5. the whole piece. Passages that stand in different surroundings differ as stretches, but
   their pieces are equal again, so that a hot passage comes down to a few different pieces.

Digits 1, 3 and 4 are counted by 64-bit hashes and looked up in bit tables of fixed size:
they only turn windows away, and what they let through wrongly ends on a later digit.
Digits 2 and 5 decide that bytes are equal, by 128-bit digests of the bytes: among 10**13
different stretches two would be taken for equal with a probability of 2e-13.

No step takes a group into one task, whatever its size. Nothing here pairs the members of a
group, and the joins to hot groups are plain ones, whose larger side adaptive execution can
split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.bitfilter import bit_rows, bit_table, in_table, only_marked
from gavelflow.llm.scratch import Scratch

#: Text bytes that one numpy pass over anchors takes.
SLICE_BYTES = 256 << 10


@dataclass(frozen=True)
class Scheme:
    """unit: "byte", or "word" for [^\\x20\\x09-\\x0D]+."""

    unit: str
    window: int
    gram: int


@dataclass
class Units:
    """The units of some rows: stretch [a, b) of units is data[at[a]:end[b - 1]]."""

    data: np.ndarray
    at: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row, and the end
    hashes: np.ndarray | None = None

    @classmethod
    def of(cls, scheme: Scheme, raw: np.ndarray, offsets: np.ndarray) -> Units:
        if scheme.unit == "byte":
            at = np.arange(len(raw), dtype=np.int64)
            return cls(raw, at, at + 1, offsets)
        start, end, row = K.runs(~K.ASCII_SPACE[raw], offsets)
        size = end - start
        close = np.cumsum(size + 1)
        data = np.full(int(close[-1]) if len(close) else 0, 0x20, np.uint8)
        inside = np.ones(len(data), bool)
        inside[close - 1] = False
        data[inside] = raw[K.gathered(size, start)]
        return cls(data, close - 1 - size, close - 1, np.searchsorted(row, np.arange(len(offsets))))

    def grams(self, n: int) -> np.ndarray:
        """A hash of each n consecutive units, not yet spread over its low bits."""
        count = len(self.at) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        prefix = K.prefix_sums(self.data)
        _, down = K.powers(len(prefix))
        if len(self.at) == len(self.data):  # bytes: places are consecutive
            out = prefix[n:] - prefix[:count]
            out *= down[:count]
            return out
        out = prefix[self.end[n - 1 :]] - prefix[self.at[:count]]
        out *= down[self.at[:count]]
        return out


def window_runs(scheme: Scheme, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, row, first window, windows, units from the first window to the anchor)
    of each run; window places are absolute."""
    none = np.empty(0, np.int64)
    grams = units.grams(scheme.gram)
    width = scheme.window - scheme.gram + 1
    if len(grams) < width:
        return none.astype(np.uint64), none, none, none, none
    bits = np.uint64(max(24, len(grams).bit_length()))
    packed = grams >> bits
    packed <<= bits
    packed |= np.arange(len(grams), dtype=np.uint64)
    owner = K.sliding_min(packed, width)
    owner &= (np.uint64(1) << bits) - np.uint64(1)
    owner = owner.view(np.int64)
    windows = np.diff(units.first) - scheme.window + 1
    has = np.flatnonzero(windows > 0)
    at = K.gathered(windows[has], units.first[:-1][has])
    row = np.repeat(has, windows[has])
    own = owner[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(opens)
    return K.mixed(grams[own[lead]]), row[lead], at[lead], np.diff(lead, append=len(at)), own[lead] - at[lead]


def _sliced(batch_columns: list[pa.Array], text: pa.Array, scheme: Scheme):
    raw, offsets = K.text_bytes(text)
    for lo, hi in K.slices(offsets, SLICE_BYTES):
        units = Units.of(scheme, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield [c.slice(lo, hi - lo) for c in batch_columns], units, lo


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """x_id, x_hash, x_text: (x_id, x_hash) names a text; rows that share it are copies."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("x_id"), F.xxhash64(text).alias("x_hash"), text.alias("x_text"))


def _anchor_counts(rows: DataFrame, scheme: Scheme) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, units, _ in _sliced([], batch.column(0), scheme):
                values, counts = np.unique(window_runs(scheme, units)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    return rows.select("x_text").mapInArrow(of, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _candidate_runs(rows: DataFrame, scheme: Scheme, held) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for (ids, hashes), units, _ in _sliced([batch.column(0), batch.column(1)], batch.column(2), scheme):
                found = window_runs(scheme, units)
                some = np.flatnonzero(in_table(table, found[0]))
                gram, row, at, windows, anchor = (x[some] for x in found)
                data = memoryview(np.ascontiguousarray(units.data))
                last = at + windows + scheme.window - 2
                stretch = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(units.at[at].tolist(), units.end[last].tolist(), strict=True)] if len(at) else []
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pick), hashes.take(pick), pa.array((at - units.first[row]).astype(np.int64)), pa.array(windows.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(anchor.astype(np.int32)), pa.array(stretch, pa.binary())],
                    names=["x_id", "x_hash", "place", "windows", "gram", "anchor", "stretch"],
                )

    return rows.mapInArrow(of, "x_id long, x_hash long, place long, windows int, gram long, anchor int, stretch binary")


@dataclass
class Repeats:
    """runs: x_id, x_hash, place, windows, gram, anchor, stretch of candidate runs;
    stretches: gram, stretch, n (runs), different (stretches of the gram), and x_id, x_hash,
    place, windows, anchor of one run of the smallest id."""

    scratch: Scratch
    rows: DataFrame
    runs: DataFrame
    stretches: DataFrame


def find(docs: DataFrame, scheme: Scheme, scratch: Scratch, id_col: str, text_col: str) -> Repeats:
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    repeated = scratch.save(_anchor_counts(rows, scheme).filter("n > 1").select("gram"), "grams")
    held = spark.sparkContext.broadcast(bit_table(repeated, F.col("gram")))
    runs = scratch.save(_candidate_runs(rows, scheme, held), "runs")
    first = F.min(F.struct(F.col("x_id").isNull().alias("none"), "x_id", "x_hash", "place", "windows", "anchor")).alias("first")
    stretches = runs.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("n"), first)
    stretches = scratch.save(stretches.select("gram", "stretch", "n", "first.*"), "stretches")
    shared = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("all")).filter("different > 1")
    shared = scratch.save(shared.select("gram", "different"), "shared")
    stretches = stretches.join(shared, "gram", "left").filter("n > 1 OR different > 1")
    stretches = scratch.save(stretches.withColumn("different", F.coalesce("different", F.lit(1))), "repeated")
    for name in ("grams", "stretches", "shared"):
        scratch.drop(name)
    return Repeats(scratch, rows, runs, stretches)


def with_text(repeats: Repeats, wanted: DataFrame, scheme: Scheme, extra: str) -> DataFrame:
    """wanted rows (x_id, x_hash, place, windows, and the columns of ``extra``) with their
    stretch's bytes as ``bytes``. Texts that nothing is wanted of are turned away first."""
    names = [c.split()[0] for c in extra.split(", ")]
    wanted = repeats.scratch.save(wanted, "wanted")
    lists = wanted.groupBy("x_id", "x_hash").agg(F.collect_set(F.struct("place", "windows", *names)).alias("w"))
    rows = only_marked(repeats.rows, F.col("x_hash"), repeats.scratch.save(bit_rows(wanted, F.col("x_hash")), "wanted-marks"))
    # Of several copies of a text one is enough: the lists hold places in the text.
    rows = rows.join(lists.withColumnRenamed("x_id", "y_id").withColumnRenamed("x_hash", "y_hash"), F.col("x_hash").eqNullSafe(F.col("y_hash")) & F.col("x_id").eqNullSafe(F.col("y_id")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, hashes, w), units, _ in _sliced([batch.column(0), batch.column(1), batch.column(3)], batch.column(2), scheme):
                flat = w.flatten()
                row = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
                place, windows = flat.field("place").to_numpy(), flat.field("windows").to_numpy()
                at = units.first[row] + place
                last = at + windows + scheme.window - 2
                data = np.ascontiguousarray(units.data).tobytes()
                parts = [data[a:b] for a, b in zip(units.at[at].tolist(), units.end[last].tolist(), strict=True)] if len(at) else []
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pick), hashes.take(pick), flat.field("place"), flat.field("windows"), *[flat.field(n) for n in names], pa.array(parts, pa.binary())],
                    names=["x_id", "x_hash", "place", "windows", *names, "bytes"],
                )

    out = rows.select("x_id", "x_hash", "x_text", "w").mapInArrow(of, f"x_id long, x_hash long, place long, windows int, {extra}, bytes binary")
    return out.dropDuplicates(["gram", "x_id", "x_hash", "place"]) if "gram" in names else out


def covered_texts(repeats: Repeats, spans: DataFrame, scheme: Scheme, digest: Callable, schema: str) -> DataFrame:
    """digest(ids, units, spans of each row) of every row of the corpus.

    spans: x_id, x_hash, place, windows. Texts without spans don't move; the others meet
    their spans in a join by text.
    """
    spans = repeats.scratch.save(spans, "spans")
    marks = repeats.scratch.save(bit_rows(spans, F.col("x_hash")), "span-marks")
    # A set: repeated rows of one text have the same spans.
    lists = spans.groupBy("x_id", "x_hash").agg(F.collect_set(F.struct("place", "windows")).alias("w"))
    lists = lists.withColumnRenamed("x_id", "y_id").withColumnRenamed("x_hash", "y_hash")
    hit = only_marked(repeats.rows, F.col("x_hash"), marks).join(lists, F.col("x_hash").eqNullSafe(F.col("y_hash")) & F.col("x_id").eqNullSafe(F.col("y_id")), "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, w), units, _ in _sliced([batch.column(0), batch.column(2)], batch.column(1), scheme):
                w = w.fill_null([]) if w.null_count else w
                flat = w.flatten()
                row = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
                place, windows = flat.field("place").to_numpy(), flat.field("windows").to_numpy()
                yield digest(ids, units, covered(units, row, place, windows + scheme.window - 1))

    none = F.array().cast("array<struct<place:bigint,windows:int>>")
    clean = only_marked(repeats.rows, F.col("x_hash"), marks, marked=False).select("x_id", "x_text", none.alias("w"))
    return hit.select("x_id", "x_text", "w").mapInArrow(of, schema).unionByName(clean.mapInArrow(of, schema))


def covered(units: Units, row: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which units lie in a span."""
    change = np.zeros(len(units.at) + 1, np.int64)
    np.add.at(change, units.first[row] + place, 1)
    np.add.at(change, units.first[row] + place + size, -1)
    return np.cumsum(change[:-1]) > 0


#: Cuts of a run's windows by their anchor's place.
SEGMENTS = 4


def _windows_of(batch: pa.RecordBatch, scheme: Scheme, prefix: bool = True):
    """The windows of stretches: (units, prefix sums, row, first unit, segment, gram)."""
    data, at = K.text_bytes_of_binary(batch.column("bytes"))
    windows = np.asarray(batch.column("windows"))
    units = Units.of(scheme, data, at)
    first = K.gathered(windows, units.first[:-1])
    row = np.repeat(np.arange(len(windows)), windows)
    away = np.asarray(batch.column("anchor"))[row] - (first - units.first[row])
    width = scheme.window - scheme.gram + 1
    return units, K.prefix_sums(units.data), row, first, away // -(-width // SEGMENTS), np.asarray(batch.column("gram")).view(np.uint64)


def _cores(batch: pa.RecordBatch, scheme: Scheme) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(_windows_of(), the core's hash of each segment, the segment of each window)."""
    found = units, prefix, row, first, segment, gram = _windows_of(batch, scheme)
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
    lead = np.flatnonzero(opens)
    span = -(-(scheme.window - scheme.gram + 1) // SEGMENTS)
    # The middle that all windows of a whole segment share; a run may own a part of it only.
    anchor = units.first[row[lead]] + np.asarray(batch.column("anchor"))[row[lead]]
    lo = anchor - segment[lead] * span
    hi = anchor - np.minimum((segment[lead] + 1) * span - 1, scheme.window - scheme.gram) + scheme.window
    h = K.span_hashes(prefix, units.at[lo], units.end[hi - 1]) if len(lead) else np.empty(0, np.uint64)
    return found, K.mixed(h + gram[row[lead]] + segment[lead].astype(np.uint64)), np.cumsum(opens) - 1


def pieces(repeats: Repeats, parts: DataFrame, scheme: Scheme, extra: str) -> DataFrame:
    """Digits 3 and 4: x_id, x_hash, place, windows, gram, the columns of ``extra``, piece
    (digest) and bytes of each piece. parts: different stretches, as with_text() gives them."""
    spark, scratch = repeats.rows.sparkSession, repeats.scratch
    names = [c.split()[0] for c in extra.split(", ")] if extra else []

    def repeated(keys: DataFrame, name: str):
        several = scratch.save(keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), name)
        return spark.sparkContext.broadcast(bit_table(several, F.col("key")))

    def counted(h: np.ndarray) -> pa.RecordBatch:
        key, n = np.unique(h, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.slices(K.text_bytes_of_binary(batch.column("bytes"))[1], SLICE_BYTES):
                yield batch.slice(lo, hi - lo)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield counted(_cores(batch, scheme)[1])

    of_cores = repeated(parts.mapInArrow(cores, "key long, n long"), "cores")

    def open_windows(batch: pa.RecordBatch):
        (units, prefix, row, first, _, gram), core, of = _cores(batch, scheme)
        some = np.flatnonzero(in_table(of_cores.value, core)[of])
        row, first = row[some], first[some]
        h = K.span_hashes(prefix, units.at[first], units.end[first + scheme.window - 1]) if len(first) else np.empty(0, np.uint64)
        return units, row, first, K.mixed(h + gram[row])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield counted(open_windows(batch)[3])

    of_windows = repeated(parts.mapInArrow(windows, "key long, n long"), "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            units, row, first, h = open_windows(batch)
            some = np.flatnonzero(in_table(of_windows.value, h))
            row, first = row[some], first[some]
            opens = np.ones(len(row), bool)
            opens[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
            lead = np.flatnonzero(opens)
            size = np.diff(lead, append=len(row))
            row, first = row[lead], first[lead]
            data = np.ascontiguousarray(units.data).tobytes()
            ends = units.end[first + size + scheme.window - 2] if len(first) else first
            body = [data[a:b] for a, b in zip(units.at[first].tolist(), ends.tolist(), strict=True)] if len(first) else []
            pick = pa.array(row)
            place = np.asarray(batch.column("place"))[row] + first - units.first[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("x_id").take(pick), batch.column("x_hash").take(pick), pa.array(place), pa.array(size.astype(np.int32)), batch.column("gram").take(pick)]
                + [batch.column(n).take(pick) for n in names]
                + [pa.array([xxhash.xxh3_128_digest(x) for x in body], pa.binary()), pa.array(body, pa.binary())],
                names=["x_id", "x_hash", "place", "windows", "gram", *names, "piece", "bytes"],
            )

    return parts.mapInArrow(cut, "x_id long, x_hash long, place long, windows int, gram long, " + "".join(f"{c}, " for c in extra.split(", ") if c) + "piece binary, bytes binary")


def joined_windows(table: pa.Table, at: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """Spans of neighbouring windows. at: window places in their stretch, ascending in each row."""
    opens = np.ones(len(at), bool)
    opens[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    lead = np.flatnonzero(opens)
    pick = pa.array(row[lead])
    column = lambda c: table.column(c).combine_chunks().take(pick)
    place = np.asarray(table.column("place"))[row[lead]] + at[lead]
    return pa.RecordBatch.from_arrays(
        [column("x_id"), column("x_hash"), pa.array(place.astype(np.int64)), pa.array(np.diff(lead, append=len(at)).astype(np.int32))],
        names=["x_id", "x_hash", "place", "windows"],
    )
