"""Near-duplicate classes by BagMinHash signatures of word shingle counts.

A text is the multiset of its shingles of five words (ASCII-lower-cased runs of letters
and digits). A signature has BANDS * ROWS components. For every shingle, a Poisson
process runs over time and weight: the weight axis is cut into (0, 1], (1, 2], (2, 4],
(4, 8] and so on, each with a process of its own whose rate is the interval's length;
a point counts if it lies below the shingle's weight in the text and goes to one of the
components. A component keeps its earliest point. Two texts agree in a component with
the probability of their weighted Jaccard similarity (sum of smaller counts over sum of
larger ones). Time runs only until every component has a point, so that a signature
costs about m ln m points whatever the text's length.

Texts that agree in all rows of a band meet in a bucket. No bucket is expanded into
pairs: its members are tied to its smallest one, its representative, and what is tied
together, over all bands, is a family. Each family is then verified on exact multisets.
First a text is held against its FIRST_TIES smallest representatives; what holds joins
texts into sets. Only links between two sets can still change a class. So the texts outside
a family's largest set, its open ones, are then held against all texts of the family, in
blocks of bounded count and bytes, where an inverted index of shingles gives a text's
overlap with all others at once. An open text whose rarest shingles, of more than a fifth
of its weight, stand nowhere else can have no partner and is passed over. A hot family thus
costs its size times the blocks of its open texts, not the square of its size. A task
reports the links that join two sets, so what it reports is fewer than its texts. Classes
are what links connect. Two texts at the threshold miss every band with a probability of
(1 - 0.8 ** 6) ** 42 = 3e-6.

Defined cases: null text counts as empty; equal texts are one node and share a class,
the empty ones too; a text of one to four words is one shingle; the class id is the
smallest id in it (null ids last); repeated rows keep a row each; an empty table gives
an empty result; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.bitfilter import bit_rows, only_marked
from gavelflow.llm.decontamination import shingle_hashes, words_of
from gavelflow.llm.scratch import Scratch

BANDS, ROWS = 42, 6
SHINGLE = 5
STEP = np.uint64(0xD1B54A32D192ED03)
#: Text bytes whose signatures are drawn together.
SLICE_BYTES = 256 << 10


def multisets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash; hashed a slice at a time."""
    parts = []
    for lo, hi in K.slices(offsets, SLICE_BYTES):
        row, h, count = _multisets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        parts.append((row + lo, h, count))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _multisets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, start, end, row = words_of(raw, offsets)
    word = K.span_hashes(K.prefix_sums(low), start, end)
    h = shingle_hashes(word, row, size)
    inside = np.flatnonzero(h)
    rows, hashes = [row[inside]], [h[inside]]
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    for short in range(1, size):
        some = np.flatnonzero(n_words == short)
        if len(some):
            first = np.searchsorted(row, some)
            rows.append(some)
            hashes.append(shingle_hashes(word, row, short)[first])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    opens = np.ones(len(h), bool)
    opens[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(opens)
    return row[lead], h[lead], np.diff(lead, append=len(h))


def bag_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """rows x m point ids; 0 for rows without elements."""
    signature = np.zeros((rows, m), np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    # Processes: an element's weight intervals (0, 1], (1, 2], (2, 4], ...
    intervals = np.ceil(np.log2(weight)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(element)), intervals)
    level = K.gathered(intervals, np.zeros(len(element), np.int64))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(float)
    seed = K.mixed(element[which] + level.astype(np.uint64) * STEP)
    of_row, top = row[which], weight[which]
    left = np.flatnonzero(total > 0)
    horizon = np.zeros(rows)
    horizon[left] = m * (np.log(m) + 3) / total[left]
    while len(left):
        mine = np.zeros(rows, bool)
        mine[left] = True
        active = np.flatnonzero(mine[of_row])
        now, drawn = np.zeros(len(active)), np.zeros(len(active), np.int64)
        best = np.full(rows * m, np.inf)
        points = []
        while len(active):
            until = horizon[of_row[active]]
            block = np.clip(np.ceil((until - now) * rate[active]) + 1, 1, 64).astype(np.int64)
            owner = np.repeat(np.arange(len(active)), block)
            point = K.mixed(seed[active][owner] + (K.gathered(block, drawn) + 1).astype(np.uint64) * K.BASE)
            # The point's own bits draw its gap; mixed again, its place and component.
            gap = -np.log(((point >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[active][owner]
            run = np.cumsum(gap)
            ends = np.cumsum(block)
            before = np.concatenate([[0.0], run[ends[:-1] - 1]]) if len(ends) else run
            at = run + (now - before)[owner]
            more = K.mixed(point + STEP)
            process = active[owner]
            high = low[process] + np.ceil(((more >> np.uint64(32)).astype(float) + 0.5) * 2.0**-32 * rate[process])
            good = np.flatnonzero((at <= until[owner]) & (high <= top[process]))
            slot = of_row[process[good]] * m + ((more[good] & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, slot, at[good])
            points.append((slot, at[good], point[good]))
            now, drawn = at[ends - 1], drawn + block
            on = now <= until
            active, now, drawn = active[on], now[on], drawn[on]
        full = np.isfinite(best.reshape(rows, m)).all(axis=1)
        flat = signature.reshape(-1)
        for slot, at, point in points:
            won = (at == best[slot]) & full[slot // m]
            flat[slot[won]] = point[won]
        left = left[~full[left]]
        horizon[left] *= 2
    return signature


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        out = K.mixed(out * K.BASE + parts[:, :, r])
    return K.mixed(out + np.arange(bands, dtype=np.uint64) * STEP)


def _nodes(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """x_sha, x_id (smallest), bands of each different text."""
    m = bands * rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column(2))
            for lo, hi in K.slices(offsets, SLICE_BYTES):
                row, h, count = multisets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                signature = bag_min_hash(row, h, count, hi - lo, m)
                some = signature.any(axis=1)
                at = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.where(some, bands, 0), out=at[1:])
                hashes = band_hashes(signature[some], bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.ravel().view(np.int64)))],
                    names=["x_id", "x_sha", "bands"],
                )

    signed = docs.mapInArrow(of, "x_id long, x_sha binary, bands array<long>")
    # Copies have equal signatures, so any of them will do.
    return signed.groupBy("x_sha").agg(F.min("x_id").alias("x_id"), F.first("bands").alias("bands"))


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label of every linked node: the smallest node that links reach. Labels travel along links and
    along labels themselves, so that chains shorten by half each round."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = scratch.save(both, f"{name}-links")
    labels = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), f"{name}-labels0")
    k = 0
    while True:
        k += 1
        met = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("met"))
        new = labels.join(met.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "met").alias("label"))
        # A node's label follows its label's label.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = scratch.save(new, f"{name}-labels{k}")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            break
    return labels


def alike(raw: np.ndarray, offsets: np.ndarray, other_raw: np.ndarray, other_offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two columns of texts reach the threshold."""
    n = len(offsets) - 1
    sides = [multisets(raw, offsets), multisets(other_raw, other_offsets)]
    row, h, count = (np.concatenate(x) for x in zip(*sides, strict=True))
    size = np.bincount(row, weights=count, minlength=n)
    order = np.lexsort((h, row))
    row, h, count = row[order], h[order], count[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(row[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
    return (shared >= threshold * (size - shared) - 1e-9) & (shared > 0)


def links_among(group: np.ndarray, side: np.ndarray, node: np.ndarray, known: np.ndarray, raw: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Rows x (side 0) and y (side 1) of links of one group that join two sets.

    node: the text of each row, which may stand on both sides; known: its set so far."""
    n = len(group)
    row, h, count = multisets(raw, offsets)
    size = np.bincount(row, weights=count, minlength=n)
    key = K.mixed(h + K.mixed(group.view(np.uint64))[row])
    _, place = np.unique(key, return_inverse=True)
    there = np.flatnonzero(side[row] == 1)
    df = np.bincount(place[there], minlength=int(place.max()) + 1 if len(place) else 0)
    order = there[np.argsort(place[there], kind="stable")]
    posting, weight, start = row[order], count[order], np.cumsum(df) - df
    # A text of side 0 that stands on side 1 too is no partner of its own.
    pairs, at = np.unique(np.stack([group, node]), axis=1, return_inverse=True)
    twice = (np.bincount(at, weights=side == 1, minlength=pairs.shape[1]) > 0)[at]
    # A partner shares all but (1 - threshold) of a text's weight, so one of any shingles that weigh more.
    others = df[place] - twice[row]
    rare = np.lexsort((others, row))
    run = np.cumsum(count[rare]) - count[rare]
    first = np.searchsorted(row, np.arange(n))
    before = run - run[np.minimum(first, len(run) - 1)][row[rare]] if len(run) else run
    needed = before <= (1 - threshold) * size[row[rare]] + 1e-9
    asks = np.zeros(n, bool)
    asks[row[rare][needed & (others[rare] > 0)]] = True
    asks &= side == 0
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    last = np.searchsorted(row, np.arange(n), side="right")
    sets = known.tolist()
    for x in np.flatnonzero(asks).tolist():
        mine = slice(int(first[x]), int(last[x]))
        found = place[mine]
        where = K.gathered(df[found], start[found])
        shared = np.bincount(posting[where], weights=np.minimum(weight[where], np.repeat(count[mine], df[found])), minlength=n)
        good = np.flatnonzero((shared >= threshold * (size[x] + size - shared) - 1e-9) & (shared > 0))
        for y in good.tolist():
            a, b = find(sets[x]), find(sets[y])
            if a != b:
                root[max(a, b)] = min(a, b)
                out[0].append(x)
                out[1].append(y)
    return out


#: Representatives that a text is held against first, and texts of one of them in a task.
FIRST_TIES, PIVOT_TEXTS = 3, 500
#: Texts and bytes of one block of a family, and of the groups that a task takes together.
BLOCK_TEXTS, BLOCK_BYTES = 300, 2 << 20


def _first_links(ties: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """a, b of the ties that hold, of each text's first ones. ties: a, b (representative)."""
    some = ties.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("turn") <= FIRST_TIES)
    some = scratch.save(some.select("a", "b"), "first-ties")
    # A hot representative is copied over as many tasks as its texts need.
    hot = some.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PIVOT_TEXTS).cast("int").alias("tasks")).filter("tasks > 1")
    hot = scratch.save(hot, "hot-representatives")
    tasks = F.coalesce("tasks", F.lit(1))
    asked = some.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), tasks).cast("int").alias("task"))
    asked = asked.join(texts.select(F.col("node").alias("a"), "text").hint("merge"), "a")
    pivots = some.select("b").distinct().join(hot, "b", "left").select("b", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
    pivots = pivots.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")).hint("merge"), "b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column(2))
            other_raw, other_offsets = K.text_bytes(batch.column(3))
            held = np.zeros(batch.num_rows, bool)
            for lo, hi in K.slices(offsets + other_offsets, SLICE_BYTES):
                held[lo:hi] = alike(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], other_raw[other_offsets[lo] : other_offsets[hi]], other_offsets[lo : hi + 1] - other_offsets[lo], threshold)
            pick = pa.array(np.flatnonzero(held))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick)], names=["a", "b"])

    return asked.join(pivots.hint("merge"), ["b", "task"]).select("a", "b", "text", "other").mapInArrow(of, "a long, b long")


def _links(members: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """a, b: links that join the sets of each family. members: node, family, known (its set), text."""
    sets = members.groupBy("family", "known").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_BYTES)).cast("int"), F.lit(1))
    whole = sets.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.max(F.struct("n", "bytes", "known")).alias("largest"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    whole = whole.filter("sets > 1").select("family", F.col("largest.known").alias("largest"), blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes")).alias("open_blocks"))
    whole = scratch.save(whole, "families")
    dealt = members.join(whole, "family").withColumn("opened", F.col("known") != F.col("largest"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    open_block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("open_blocks")).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = F.transform(all_of("blocks"), lambda j: F.struct(F.lit(0).alias("side"), open_block.alias("i"), j.alias("j")))
    told = F.transform(all_of("open_blocks"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), block.alias("j")))
    met = dealt.withColumn("m", F.explode(F.when(F.col("opened"), F.concat(asked, told)).otherwise(told)))
    rows = met.select(F.xxhash64("family", "m.i", "m.j").alias("meeting"), "m.side", "node", "known", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            raw, offsets = K.text_bytes(table.column("text"))
            meeting, side, node, known = (np.asarray(table.column(c)) for c in ("meeting", "side", "node", "known"))
            x, y = links_among(meeting, side, node, known, raw, offsets, threshold)
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

        weight = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                held.append(part)
                weight += part.num_rows
                size += K.text_bytes(part.column(4))[0].size
                if weight < BLOCK_TEXTS and size < BLOCK_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                meeting = np.asarray(table.column("meeting"))
                cut = int(np.searchsorted(meeting, meeting[-1]))
                if cut:
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    weight, size = len(meeting) - cut, sum(K.text_bytes(b.column(4))[0].size for b in held)
        if held:
            yield done(pa.Table.from_batches(held))

    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(of, "a long, b long")


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("x_id"), F.unhex(F.sha2(text, 256)).alias("x_sha"), text.alias("x_text"))


def _classes_of_texts(source: DataFrame, scratch: Scratch, threshold: float, bands: int, rows: int) -> DataFrame:
    """x_sha, class_id, keep_sha (the text of the smallest id), class_size (rows) of each different text."""
    nodes = _nodes(source, bands, rows).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.save(nodes, "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    several = scratch.save(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).filter("size > 1").select("bucket", "pivot"), "buckets")
    ties = members.join(several.hint("merge"), "bucket").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    # A node's smallest tie stands for it: its other ties join theirs to that one, and are few.
    tied_to = scratch.save(ties.withColumn("least", F.min("b").over(Window.partitionBy("a"))), "ties")
    ties = tied_to.select("a", F.col("least").alias("b")).unionByName(tied_to.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()
    families = connected(scratch.save(ties, "short-ties"), scratch, "family").withColumnRenamed("label", "family")
    tied = scratch.save(families.join(nodes.select("node", "x_sha", "x_id").hint("merge"), "node"), "tied")
    marks = scratch.save(bit_rows(tied, F.xxhash64("x_sha")), "marks")
    found = only_marked(source, F.xxhash64("x_sha"), marks).withColumnRenamed("x_id", "y_id")
    texts = found.join(tied.hint("merge"), "x_sha").filter(F.col("x_id").eqNullSafe(F.col("y_id"))).select("node", "family", F.col("x_text").alias("text"))
    texts = scratch.save(texts.dropDuplicates(["node"]), "texts")
    first = scratch.save(_first_links(tied_to.select("a", "b"), texts, scratch, threshold), "first-links")
    sets = connected(first, scratch, "set").withColumnRenamed("label", "known")
    members = texts.join(sets.hint("merge"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    links = scratch.save(_links(members, scratch, threshold), "links")
    for name in ("texts", "first-ties"):
        scratch.drop(name)
    links = links.unionByName(sets.select(F.col("node").alias("a"), F.col("known").alias("b")).filter("a <> b"))
    labels = connected(links, scratch, "class")
    labels = nodes.select("node").join(labels.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    named = nodes.select("node", "x_sha", F.struct(F.col("x_id").isNull(), F.col("x_id").alias("id"), F.col("x_sha").alias("sha")).alias("least")).join(labels, "node")
    of_class = scratch.save(named.groupBy("label").agg(F.min("least").alias("least")), "classes")
    named = scratch.save(named.select("x_sha", "label").join(of_class.hint("merge"), "label").select("x_sha", "label", F.col("least.id").alias("class_id"), F.col("least.sha").alias("keep_sha")), "named")
    sizes = scratch.save(named.join(source.groupBy("x_sha").agg(F.count(F.lit(1)).alias("copies")), "x_sha"), "sizes")
    of_class = scratch.save(sizes.groupBy("label").agg(F.sum("copies").alias("class_size")), "class-sizes")
    return scratch.save(sizes.join(of_class.hint("merge"), "label").select("x_sha", "class_id", "keep_sha", "class_size"), "told")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row; kept: the text that stands for its class."""
    source = _text_rows(docs, id_col, text_col)
    told = _classes_of_texts(source, Scratch(docs.sparkSession, "near-dedup"), threshold, bands, rows)
    kept = (F.col("x_sha") == F.col("keep_sha")) & F.col("x_id").eqNullSafe(F.col("class_id"))
    return source.select("x_id", "x_sha").join(told.hint("merge"), "x_sha").select(F.col("x_id").alias("doc_id"), "class_id", "class_size", kept.alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each class: that of the smallest id (one of several such rows)."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    told = _classes_of_texts(_text_rows(docs, id_col, text_col), scratch, threshold, bands, rows)
    several = scratch.save(told.filter("class_size > 1").select("x_sha", "class_id", "keep_sha"), "several")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("x_row"), F.col(id_col).cast("long").alias("x_id"), F.unhex(F.sha2(text, 256)).alias("x_sha"))
    key = F.xxhash64("x_sha")
    marks = scratch.save(bit_rows(several, key), "several-marks")
    met = only_marked(keyed, key, marks).join(several.hint("merge"), "x_sha", "left")
    alone = met.filter("keep_sha IS NULL").select("x_row")
    chosen = met.filter((F.col("x_sha") == F.col("keep_sha")) & F.col("x_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["x_sha"]).select("x_row")
    clean = only_marked(keyed, key, marks, marked=False).select("x_row")
    return clean.unionByName(alone).unionByName(chosen).select("x_row.*")
