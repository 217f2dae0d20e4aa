"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows that may be learnt from. Terms are all
words of the examples (ASCII-lower-cased runs of letters and digits), and those word stems
(the first STEMS characters of a longer word) that are tied to a label. Inverse document
frequencies count all documents. A term whose examples' labels differ from the rest beyond
chance is marked and weighs MARKED times as much, so that one telling word isn't drowned
by a page of topic; a stem stands for inflected forms too rare to tell by themselves.

The index is block-max: examples that share their heaviest terms stand together in blocks,
and each term keeps its largest weight in a block. The sum of a text's weights times these
maxima bounds its cosine with any example of the block. Blocks are opened from the highest
bound down, until no bound reaches the k-th cosine found. Bounds rule out little where they
rest on everyday words, so for texts whose vector is not mostly marked terms, and where too
many blocks stay open, the postings of all examples are summed instead. Both ways give the
same neighbours: the k nearest and all that tie with the last. Examples with equal vectors are one entry, which
votes with the toxic share of its labels, by the fourth power of its cosine over that of
the nearest entry. Words that no example holds lengthen a text's vector, but change neither
the order of its neighbours nor the ratios of their cosines, so they don't enter.

Votes become probabilities by isotonic regression over a bounded sample of the examples,
each voted on by all others.

Labels, language, source and id are never inputs of a score; learning rows are picked by
the remainder of crc32 of the id's digits, which is not 1.

Defined cases: null text counts as empty; a text that shares no term with an example, the
empty one too, gets the toxic rate of the examples without words; labels that are null, or
whose id is null or has no document, are not learnt from; repeated label rows are copies;
without any example every score is 0; repeated rows are scored alike; an empty table gives
an empty result; extra columns are ignored (``accepted`` keeps them), whatever they are
called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.decontamination import words_of
from gavelflow.llm.scratch import Scratch

#: Most labelled rows that are learnt from, most terms that are marked, and most examples
#: that the votes are calibrated on.
EXAMPLES = 16_384
TERMS = 4_096
CALIBRATED = 2_048
#: Lengths of word stems, in characters.
STEMS = (4, 5, 6, 7, 8)
#: A marked term needs this many examples and this deviance from the overall rate (G-test).
LEAST_EXAMPLES = 4
LEAST_DEVIANCE = 12.0
MARKED = 10.0
NEIGHBOURS = 25
#: Weight of the overall rate among the labels of examples without words.
PRIOR = 0.5
#: Examples in a block; terms that are held densely; texts that are looked up together.
BLOCK = 64
FREQUENT = 256
#: A term of more entries than this share of the blocks is held densely by block.
WIDE = 4
TOGETHER = 64
#: Results that a task keeps for copies of the texts.
REMEMBERED = 8_192
STEM_SALT = np.uint64(0x632BE59BD9B4E019)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


def word_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(row, hash) of each word, and (row, hash) of the stems of each length."""
    low, start, end, row = words_of(raw, offsets)
    prefix = K.prefix_sums(low)
    lead = np.flatnonzero((low & 0xC0) != 0x80)
    first, stop = np.searchsorted(lead, start), np.searchsorted(lead, end)
    stems = []
    for n in STEMS:
        longer = np.flatnonzero(stop - first > n)
        stems.append((row[longer], K.mixed(K.span_hashes(prefix, start[longer], lead[first[longer] + n]) ^ STEM_SALT)))
    return row, K.span_hashes(prefix, start, end), stems


def _sliced(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi in K.slices(offsets):
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count), sorted by row and hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    opens = np.ones(len(h), bool)
    opens[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(opens)
    return row[lead], h[lead], np.diff(lead, append=len(h))


class Vocabulary:
    """The terms: sorted hashes, with the marked stems among them."""

    def __init__(self, hashes: np.ndarray, stems: np.ndarray):
        self.hashes, self.stems = hashes, np.sort(stems)
        self.words_seen, self.stems_seen = _bits(hashes), _bits(self.stems)

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the known terms, sorted by row and term."""
        row, h, stems = word_terms(raw, offsets)
        rows, hashes = [row], [h]
        for r, s in stems if len(self.stems) else []:
            some = np.flatnonzero(self.stems_seen[(s >> np.uint64(44)).astype(np.int64)])
            some = some[_found(self.stems, s[some])[1]]
            rows.append(r[some])
            hashes.append(s[some])
        row, h = np.concatenate(rows), np.concatenate(hashes)
        maybe = np.flatnonzero(self.words_seen[(h >> np.uint64(44)).astype(np.int64)])
        maybe = maybe[np.argsort(h[maybe])]  # looked up in order, neighbours are still in the cache
        at, hit = _found(self.hashes, h[maybe])
        key, count = np.unique(row[maybe][hit] * max(len(self.hashes), 1) + at[hit], return_counts=True)
        return *np.divmod(key, max(len(self.hashes), 1)), count


def _bits(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def _found(wanted: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the sorted wanted values, whether it is there)."""
    if not len(wanted):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    return at, wanted[at] == h


#: (the place of each term among the frequent ones, or -1; their weights by owner; (first, owner,
#: weight) of the others).
Postings = tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]


class Index:
    """Entries (unit vectors) in blocks, with each term's largest weight by block.

    scale: the factor of each term (inverse document frequency, marks); first, term,
    count: each entry's terms; share: its toxic share of labels; marked: by term."""

    def __init__(self, scale: np.ndarray, first: np.ndarray, term: np.ndarray, count: np.ndarray, share: np.ndarray, marked: np.ndarray, block: int = BLOCK):
        size = len(share)
        self.marked = marked
        # Temporary arrays of one entry for each word of the examples are let go one by one.
        sizes = np.diff(first)
        weight = np.log(count, dtype=np.float32)
        weight += 1
        weight *= scale.astype(np.float32)[term]
        norm, top = np.zeros(size, np.float32), np.zeros(size, np.float32)
        if len(weight):
            some = np.flatnonzero(sizes)
            norm[some] = np.sqrt(np.add.reduceat(weight * weight, first[:-1][some], dtype=np.float64))
            top[some] = np.maximum.reduceat(weight, first[:-1][some])
        # Entries stand by their heaviest term, so that blocks hold alike ones.
        heavy = np.flatnonzero(weight == np.repeat(top, sizes))
        lead = term[heavy[np.minimum(np.searchsorted(heavy, first[:-1]), max(len(heavy) - 1, 0))]] if len(heavy) else np.zeros(size, np.int32)
        weight /= np.repeat(norm, sizes)
        del heavy
        order = np.argsort(lead, kind="stable")
        where = K.gathered(sizes[order], first[:-1][order])
        self.order = order  # the place of each entry before
        self.share, self.scale, self.size = share[order], scale, size
        sizes = sizes[order]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.term, self.weight = term[where].astype(np.int32), weight[where]
        del where, weight
        entry = np.repeat(np.arange(size, dtype=np.int32), sizes)
        held = np.bincount(self.term, minlength=len(scale))
        often = np.argsort(-held, kind="stable")[:FREQUENT]
        often = often[held[often] > size // 64]
        self.blocks, self.block = -(-size // block), block
        self.single = self._postings(entry, size, often, None)
        # A term of many entries lies in many blocks: most of a text's terms are rows of the blocks' matrix.
        self.bound = self._postings(entry // block, self.blocks, np.flatnonzero(held > self.blocks // WIDE), np.maximum)

    def _postings(self, owner: np.ndarray, owners: int, often: np.ndarray, fold) -> Postings:
        """The frequent terms as a matrix, the others as (first, owner, weight) by term."""
        place = np.full(len(self.scale), -1, np.int32)
        place[often] = np.arange(len(often))
        at = place[self.term] >= 0
        dense = np.zeros((len(often), owners), np.float32)
        np.maximum.at(dense, (place[self.term[at]], owner[at]), self.weight[at])
        rest = np.flatnonzero(~at)
        rest = rest[np.argsort(self.term[rest], kind="stable")]  # owners ascend already
        del at
        # Owners are few: two bytes hold them, where they can.
        term, own, weight = self.term[rest], owner[rest].astype(np.uint16 if owners <= 1 << 16 else np.int32), self.weight[rest]
        del rest
        if fold is not None and len(term):
            opens = np.ones(len(term), bool)
            opens[1:] = (term[1:] != term[:-1]) | (own[1:] != own[:-1])
            lead = np.flatnonzero(opens)
            term, own, weight = term[lead], own[lead], fold.reduceat(weight, lead)
        return place, dense, (np.searchsorted(term, np.arange(len(self.scale) + 1)).astype(np.int32), own, weight)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.scale[terms]
        return (w / np.sqrt((w * w).sum())).astype(np.float32)

    def _sums(self, queries: list, postings: Postings, many: bool) -> Iterator[np.ndarray]:
        """For each query, by owner, the sum over shared terms of weight times weight. many: each term
        has many owners, so the frequent terms of all queries are one product, and lists are joined."""
        place, dense, (first, own, weight) = postings
        ats = [place[terms] for terms, _ in queries]
        if many:
            often = np.zeros((len(queries), len(dense)), np.float32)
            for q, (at, (_, weights)) in enumerate(zip(ats, queries, strict=True)):
                on = np.flatnonzero(at >= 0)
                often[q, at[on]] = weights[on]
            often = often @ dense
        for q, (at, (terms, weights)) in enumerate(zip(ats, queries, strict=True)):
            rare = np.flatnonzero(at < 0)
            lo, hi = first[terms[rare]], first[terms[rare] + 1]
            by = np.repeat(weights[rare], hi - lo)
            if not many:
                where = K.gathered(hi - lo, lo)
                on = np.flatnonzero(at >= 0)
                out = np.bincount(own[where], weights=weight[where] * by, minlength=dense.shape[1])
                out = out + weights[on] @ dense[at[on]]  # whole numbers where nothing was counted
            elif len(rare):
                spans = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                by = by * np.concatenate([weight[x] for x in spans])
                out = np.bincount(np.concatenate([own[x] for x in spans], dtype=np.intp), weights=by, minlength=dense.shape[1])
                out += often[q]
            else:
                out = often[q].astype(np.float64)
            yield out

    def _opened(self, blocks: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of whole blocks. query: the weight of every term."""
        entry, near = [], []
        for at in (blocks * self.block).tolist():
            to = min(at + self.block, self.size)
            first = self.first[at : to + 1]
            both = query[self.term[first[0] : first[-1]]]
            both *= self.weight[first[0] : first[-1]]
            entry.append(np.arange(at, to))
            near.append(np.add.reduceat(both, first[:-1] - first[0], dtype=np.float64))
        return np.concatenate(entry), np.concatenate(near)

    def neighbours(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(entries, cosines) of the k nearest entries, and of all that tie with the last,
        for each query of (terms, weights). skip: an entry that each query leaves out."""
        none = (np.empty(0, np.int64), np.empty(0))
        out: list = [none] * len(queries)
        asked = [q for q, (terms, _) in enumerate(queries) if len(terms) and self.size]
        if not asked:
            return out
        telling = [q for q in asked if (queries[q][1][self.marked[queries[q][0]]] ** 2).sum() >= 0.5]
        whole, asked = [q for q in asked if q not in telling], telling
        bounds = self._sums([queries[q] for q in asked], self.bound, False)
        query = np.zeros(len(self.scale), np.float32)
        for bound, q in zip(bounds, asked, strict=True):
            bound += 1e-5
            by = np.argsort(-bound, kind="stable")
            few, limit = max(1, -(-(k + 1) // self.block)), max(2, self.blocks // 8)
            terms, weights = queries[q]
            query[terms] = weights
            while True:
                entry, near = self._opened(by[:few], query)
                if skip is not None:
                    near[entry == skip[q]] = 0
                kth = -np.partition(-near, k - 1)[k - 1] if len(near) > k else 0.0
                needed = int(np.searchsorted(-bound[by], -(kth - 1e-5), side="right"))
                if needed <= few or needed > limit:
                    break
                few = needed
            query[terms] = 0
            if needed > few:
                whole.append(q)
            else:
                out[q] = self._nearest(entry, near, k)
        if whole:
            for near, q in zip(self._sums([queries[q] for q in whole], self.single, True), whole, strict=True):
                if skip is not None:
                    near[skip[q]] = 0
                out[q] = self._nearest(np.arange(self.size), near, k)
        return out

    def _nearest(self, entry: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(near) > 8 * k:
            # The k-th largest of some maxima is no more than the k-th of all.
            cut = len(near) // (4 * k)
            tops = near[: len(near) // cut * cut].reshape(-1, cut).max(axis=1)
            some = np.flatnonzero(near >= np.partition(tops, len(tops) - k)[len(tops) - k] - 1e-6)
            entry, near = entry[some], near[some]
        least = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else 0.0
        some = np.flatnonzero((near >= least - 1e-6) & (near > 0))
        return entry[some], near[some]

    def vote(self, entry: np.ndarray, near: np.ndarray) -> float:
        """The toxic share of these entries, by nearness."""
        by = (near / near.max()) ** 4
        return float((by * self.share[entry]).sum() / by.sum())


def isotonic(vote: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, probabilities) to interpolate between: pools of neighbouring votes, merged while rates fall."""
    values, at = np.unique(vote, return_inverse=True)
    pools: list[list[float]] = []
    for v, n, t in zip(values, np.bincount(at), np.bincount(at, weights=label), strict=True):
        pools.append([t, n, v * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, n, v = pools.pop()
            pools[-1][0] += t
            pools[-1][1] += n
            pools[-1][2] += v
    return np.array([v / n for _, n, v in pools]), np.array([t / n for t, n, _ in pools])


@dataclass
class Model:
    """What is broadcast: the entries' terms and counts. Each worker builds its index of them once."""

    hashes: np.ndarray
    stems: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    term: np.ndarray
    count: np.ndarray
    share: np.ndarray
    marked: np.ndarray
    bare: float  # the score of a text without terms

    @cached_property
    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.hashes, self.stems)

    @cached_property
    def index(self) -> Index:
        made = Index(self.scale, self.first, self.term, self.count, self.share, self.marked)
        self.term = self.count = None  # the index has its own
        return made


Curve = tuple[np.ndarray, np.ndarray]


def probability(vote: float, curve: Curve) -> float:
    return float(np.interp(vote, *curve)) if len(curve[0]) else vote


def _deviance(n: Column, t: Column, all_n: float, all_t: float) -> Column:
    """Deviance of a term's toxic share t / n from the overall one."""
    rate = all_t / all_n if all_n else 0.0
    part = lambda x, p: F.when(x > 0, x * F.log(x / n / F.lit(max(p, 1e-12)))).otherwise(0.0)
    return 2 * (part(t, rate) + part(n - t, 1 - rate))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, terms: int = TERMS):
    """(broadcast model, curve from votes to probabilities). The driver gets the terms of the
    examples, whose number is bounded by the parameters."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.select(F.col(id_col).cast("string").alias("x_id"), F.col(label_col).cast("int").alias("x_toxic"))
    usable = usable.filter("x_id IS NOT NULL AND x_toxic IS NOT NULL").filter(~held_out(F.col("x_id")))
    picked = usable.orderBy(F.xxhash64("x_id"), "x_id", "x_toxic").limit(examples)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("string").alias("x_id"), text.alias("x_text"))
    # At most ``examples`` pairs of an id and a number are broadcast.
    taken = rows.join(F.broadcast(picked), "x_id").select("x_toxic", "x_text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest of each text's words and their counts: texts that share it are one entry."""
        for batch in batches:
            for lo, hi, raw, offsets in _sliced(*K.text_bytes(batch.column(1))):
                row, h, _ = word_terms(raw, offsets)
                row, h, count = counted(row, h)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                key = [xxhash.xxh3_128_digest(h[a:b].tobytes() + count[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(np.diff(cuts) > 0), part.column(0), part.column(1)], names=["key", "worded", "toxic", "x_text"])

    made = taken.mapInArrow(vectors, "key binary, worded boolean, toxic int, x_text string")
    made = scratch.save(made.groupBy("key", "worded").agg(F.first("x_text").alias("x_text"), F.avg("toxic").alias("share"), F.count(F.lit(1)).alias("n")), "examples")
    worded = made.filter("worded").select("key", "share", "x_text")
    size, toxic = worded.agg(F.count(F.lit(1)), F.sum("share")).first()
    toxic = toxic or 0.0

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = batch.column(1).to_numpy()
            for lo, hi, raw, offsets in _sliced(*K.text_bytes(batch.column(2))):
                row, h, stems = word_terms(raw, offsets)
                for rows, hashes, stem in ((row, h, False), (np.concatenate([r for r, _ in stems]), np.concatenate([s for _, s in stems]), True)):
                    rows, hashes, _ = counted(rows, hashes)
                    term, where = np.unique(hashes, return_inverse=True)
                    n, t = np.bincount(where, minlength=len(term)).astype(float), np.bincount(where, weights=share[lo:hi][rows], minlength=len(term))
                    yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.full(len(term), stem)), pa.array(n), pa.array(t)], names=["term", "stem", "n", "t"])

    tally = worded.mapInArrow(tallies, "term long, stem boolean, n double, t double")
    tally = scratch.save(tally.groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "tally")
    telling = tally.filter(F.col("n") >= LEAST_EXAMPLES).withColumn("off", _deviance(F.col("n"), F.col("t"), size, toxic)).filter(F.col("off") >= LEAST_DEVIANCE)
    marks = telling.orderBy(F.desc("off"), "term").limit(terms).select("term", "stem").toArrow()
    mark, is_stem = marks.column(0).to_numpy().view(np.uint64), marks.column(1).to_numpy()
    words = tally.filter("NOT stem").select("term").toArrow().column(0).to_numpy().view(np.uint64)
    vocabulary = Vocabulary(np.unique(np.concatenate([words, mark[is_stem]])), mark[is_stem])
    scratch.drop("tally")
    spread = spark.sparkContext.broadcast(vocabulary)

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = spread.value
        total, docs_seen = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            docs_seen += batch.num_rows
            for _, _, raw, offsets in _sliced(*K.text_bytes(batch.column(0))):
                total += np.bincount(vocabulary.of(raw, offsets)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[docs_seen], total[some]]))], names=["term", "n"])

    seen = rows.select("x_text").mapInArrow(of_all, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (seen.column(k).to_numpy() for k in range(2))
    frequency = np.zeros(len(vocabulary.hashes))
    frequency[term[term >= 0]] = n[term >= 0]
    scale = np.log((1 + n[term < 0].sum()) / (1 + frequency)) + 1
    marked = np.zeros(len(scale), bool)
    marked[_found(vocabulary.hashes, mark)[0]] = True
    scale[marked] *= MARKED

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry's terms - its words, and the marked ones of its stems - with their counts."""
        for batch in batches:
            for lo, hi, raw, offsets in _sliced(*K.text_bytes(batch.column(2))):
                row, term, count = spread.value.of(raw, offsets)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                lists = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (term, count)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, part.column(1)], names=["key", "terms", "counts", "share"])

    # Some six bytes for each word of the examples; in the order of a digest.
    held = worded.mapInArrow(listed, "key binary, terms binary, counts binary, share double").toArrow().sort_by("key")
    spread.unpersist()
    data, at = K.text_bytes_of_binary(held.column("terms"))
    term, first = np.frombuffer(data, np.int32), at // 4
    count = np.frombuffer(K.text_bytes_of_binary(held.column("counts"))[0], np.int32)
    share = held.column("share").to_numpy()
    del held
    if not len(count) or count.max() < 1 << 16:
        count = count.astype(np.uint16)
    empty = made.filter("NOT worded").agg(F.sum("n"), F.sum(F.col("n") * F.col("share"))).first()
    rate = toxic / size if size else 0.0
    bare = ((empty[1] or 0.0) + PRIOR * rate) / ((empty[0] or 0) + PRIOR)
    model = Model(vocabulary.hashes, vocabulary.stems, scale, first, term, count, share, marked, float(bare))
    held = spark.sparkContext.broadcast(model)
    return held, _calibrated(spark, held, len(share))


def _calibrated(spark, model, size: int) -> Curve:
    """The curve from votes to probabilities: a sample of entries, each voted on by the others."""
    if size < 2:
        return np.empty(0), np.empty(0)
    # Entries came in the order of a hash, so the first ones are a sample.
    sample = spark.range(0, min(CALIBRATED, size), 1, 8)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value.index
        place = np.argsort(index.order)
        for batch in batches:
            votes, shares = [], []
            ids = place[batch.column(0).to_numpy()]
            for lo in range(0, len(ids), TOGETHER):
                some = ids[lo : lo + TOGETHER].tolist()
                queries = [(index.term[index.first[e] : index.first[e + 1]], index.weight[index.first[e] : index.first[e + 1]]) for e in some]
                for e, (entry, near) in zip(some, index.neighbours(queries, skip=some), strict=True):
                    if len(entry):
                        votes.append(index.vote(entry, near))
                        shares.append(float(index.share[e]))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(shares, pa.float64())], names=["vote", "share"])

    told = sample.mapInArrow(of, "vote double, share double").toArrow()
    return isotonic(told.column(0).to_numpy(), told.column(1).to_numpy()) if told.num_rows else (np.empty(0), np.empty(0))


def _scored(rows: DataFrame, columns: list[str], text: str, learnt) -> DataFrame:
    """columns of rows with x_score, and x_near and x_share of each nearest entry. text: the
    column to score, which may be among them: then it goes to the workers once."""
    text_at = rows.columns.index(text)
    pa.default_memory_pool().release_unused()  # what the driver held while it learnt

    model, curve = learnt

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        vocabulary, index = held.vocabulary, held.index
        seen: dict[bytes, tuple] = {}  # copies of a text are looked up once
        for batch in batches:
            score = np.full(batch.num_rows, held.bare)
            near_of: list = [np.empty(0)] * batch.num_rows
            share_of: list = [np.empty(0)] * batch.num_rows
            for lo, hi, raw, offsets in _sliced(*K.text_bytes(batch.column(text_at))):
                row, term, count = vocabulary.of(raw, offsets)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                for at in range(0, hi - lo, TOGETHER):
                    spans = list(zip(cuts[at : at + TOGETHER], cuts[at + 1 : at + TOGETHER + 1], strict=False))
                    keys = [xxhash.xxh3_128_digest(term[a:b].tobytes() + count[a:b].tobytes()) for a, b in spans]
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    fresh = {key: span for key, span in zip(keys, spans, strict=True) if key not in seen}
                    queries = [(term[a:b], index.vector(term[a:b], count[a:b]) if b > a else term[a:b]) for a, b in fresh.values()]
                    for key, (entry, near) in zip(fresh, index.neighbours(queries), strict=True):
                        told = probability(index.vote(entry, near), curve) if len(entry) else held.bare
                        seen[key] = (told, near, index.share[entry])
                    for r, key in enumerate(keys, lo + at):
                        score[r], near_of[r], share_of[r] = seen[key]
            cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in near_of])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x) if len(x) else np.empty(0), pa.float64())) for x in (near_of, share_of)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], pa.array(score), *lists], names=[*columns, "x_score", "x_near", "x_share"])

    none = F.array().cast("array<double>")
    schema = rows.select(*columns).withColumns({"x_score": F.lit(0.0), "x_near": none, "x_share": none}).schema
    return rows.mapInArrow(of, schema)


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (toxic share of each nearest entry) of every row."""
    learnt = learn(docs, labels, id_col=id_col, text_col=text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("x_text"))
    score = F.col("x_score")
    return _scored(rows, ["doc_id"], "x_text", learnt).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= reject_at).cast("int").alias("predicted"), F.col("x_share").alias("evidence")
    )


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches ``reject_at``."""
    learnt = learn(docs, labels, id_col=id_col, text_col=text_col)
    names = [f"x_{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = names[docs.columns.index(text_col)]
    if rows.schema[text].dataType.simpleString() != "string":
        rows, text = rows.withColumn("x_text", F.col(text).cast("string")), "x_text"
    out = _scored(rows, names, text, learnt).filter(F.col("x_score") < reject_at)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
