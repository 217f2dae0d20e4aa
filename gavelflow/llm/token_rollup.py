"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A batch of
changes - documents inserted, deleted, or revised from one count to another - is reduced to
a delta for each key, written under a name of its own, and committed by a marker file that
names that folder. The marker is written aside and moved to the batch's place by a rename
that fails if something is there, so of several committers of one batch, or of one that a
failed driver sends again, exactly one counts; the others drop what they wrote.

Totals are the sum over committed batches. ``compact`` folds them: it writes the totals,
and by the same kind of rename a numbered manifest that names this table and the batches
in it. Totals then read the newest manifest's table and the batches that it doesn't name.

Defined cases: null text counts as empty and has 0 tokens; null source or lang is a key
of its own; repeated rows each count; a key whose documents are all gone keeps a row of
zeros until ``compact`` drops it; an empty batch commits an empty delta; batch ids are file
names; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.tokens import SLICE_BYTES, encoder

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer: str, version: str, *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """source, lang, tokenizer, tokens of every row's whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column(2))
            each = [np.empty(0, np.int64)]
            for lo, hi in K.slices(offsets, SLICE_BYTES):
                each.append(encoder(tokenizer).encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(each), pa.int64())], names=["source", "lang", "tokens"])

    narrow = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(of, "source string, lang string, tokens long").select("source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("tokens")).alias("n_tokens"))


def revised(counts: DataFrame, old_col: str = "old_tokens") -> DataFrame:
    """counts also has each document's earlier number of tokens."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("tokens") - F.col(old_col)).alias("n_tokens"))


class TokenLedger:
    """Committed deltas under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def _publish(self, place: str, lines: list[str]) -> bool:
        """Puts a small file in place, unless one is there."""
        aside = self._path(f"{self.root}/aside/{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.write(bytearray("\n".join(lines).encode()))
        stream.close()
        self._fs.mkdirs(self._path(place).getParent())
        try:
            self._files.rename(aside, self._path(place), self._options)
        except Exception:
            self._fs.delete(aside, False)
            if self._fs.exists(self._path(place)):
                return False
            raise
        return True

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place) if not s.getPath().getName().startswith(".")) if self._fs.exists(place) else []

    def _lines(self, file: str) -> list[str]:
        return [r.value for r in self.spark.read.text(f"{self.root}/{file}").collect()]  # one name for each folded batch

    def is_committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/committed/{batch_id}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was new. changes: source, lang, tokenizer, n_docs, n_tokens, signed."""
        if self.is_committed(batch_id):
            return False
        folder = f"deltas/{batch_id}-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.root}/{folder}")
        if self._publish(f"{self.root}/committed/{batch_id}", [folder]):
            return True
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return False

    def _folded(self) -> tuple[int, list[str], set[str]]:
        """(number of the newest manifest, its table, the batches in it)."""
        names = self._names("folded")
        if not names:
            return 0, [], set()
        table, *batches = self._lines(f"folded/{names[-1]}")
        return int(names[-1]), [table], set(batches)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        _, tables, inside = self._folded()
        tables += [self._lines(f"committed/{b}")[0] for b in self._names("committed") if b not in inside]
        if not tables:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{t}" for t in tables])
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> bool:
        """Folds all committed batches into one table, without keys of no documents and no
        tokens. False if another fold came first."""
        number, _, _ = self._folded()
        batches, folder = self._names("committed"), f"deltas/folded-{uuid.uuid4().hex}"
        self.totals().filter("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{self.root}/{folder}")
        return self._publish(f"{self.root}/folded/{number + 1:09d}", [folder, *batches])
