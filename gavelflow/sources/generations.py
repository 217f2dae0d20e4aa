"""Publishing a board as generations, and reading the newest whole one.

A build is written to a folder of its own name, verified there, and becomes a generation
when a one-row manifest entry is renamed into place. That rename is exclusive: an id is
taken once. A build that fails, is refused or dies takes nothing away from what was there;
folders that no manifest entry names are removed when they are a day old.

Rows lie sorted by id, with Parquet bloom filters on the ids, so that a lookup reads the row
groups that can hold it. What a build is judged by (rows, repeated and missing ids, the
caller's own figures, a SHA-256 revision of its content) is observed in the pass that writes
it: the source is read once, and the files are only asked for their row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelflow.sources.content import revision_of, word_sums

KEPT = 2
MANIFEST = "generation_id string, build string, row_count long, generated_at timestamp, expires_at timestamp, revision string, figures map<string, bigint>"
IDS = ("id", "external_id")


@dataclass(frozen=True)
class Staged:
    """A build that is written but not yet a generation: what was observed of it."""

    build: str
    rows: int
    revision: str
    figures: dict[str, int]
    faults: list[str]


class Generations:
    """ids: the columns that rows are looked up by; the first is their key."""

    def __init__(self, spark: SparkSession, root: str, ids: tuple[str, ...] = IDS):
        self.spark, self.root, self.ids = spark, root.rstrip("/"), ids
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _take(self, source: str, target: str) -> bool:
        """Renames a folder, unless the target is there."""
        sc = self.spark.sparkContext
        jvm = sc._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        no_options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(self._path(f"{self.root}/{source}")), self._fs.makeQualified(self._path(f"{self.root}/{target}")), no_options)
        except Exception:
            if self._there(target):
                return False
            raise
        return True

    def stage(self, board: DataFrame, figures: dict[str, Column] | None = None, most_rows: int | None = None, block_bytes: int | None = None) -> Staged:
        """Writes a build. figures: aggregates over the rows, whole numbers, by name."""
        build, key = uuid.uuid4().hex, self.ids[0]
        place = f"{self.root}/rows/{build}"
        try:
            laid = board.repartition(key).sortWithinPartitions(key)
            laid = laid.withColumn("x_again", F.row_number().over(Window.partitionBy(key).orderBy(key)) > 1)
            own = {f"x_{name}": c for name, c in (figures or {}).items()}
            seen = Observation()
            told = [F.count(F.lit(1)).alias("rows"), F.count_if("x_again").alias("repeated"), F.count_if(F.col(key).isNull()).alias("unnamed")]
            told += [c.cast("long").alias(name) for name, c in own.items()] + word_sums(board)
            # The last stage writes, so a task that is run again is observed once.
            writer = laid.observe(seen, *told).drop("x_again").write
            for c in (c for c in self.ids if c in board.columns):
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
            if block_bytes:
                writer = writer.option("parquet.block.size", block_bytes)
            writer.parquet(place)
            n = self.spark.read.schema(board.schema).parquet(place).count()  # from the files' footers
            # Of a plan without rows Spark may observe nothing.
            got = seen.get if n else {}
            faults = [] if n else ["empty"]
            faults += [name for name in ("repeated", "unnamed") if got.get(name)]
            if n != got.get("rows", 0):
                faults.append("lost")
            if most_rows is not None and n > most_rows:
                faults.append("too-many")
            return Staged(build, n, revision_of(n, got), {name: int(got.get(f"x_{name}") or 0) for name in figures or {}}, faults)
        except Exception:
            self._delete(f"rows/{build}")
            raise

    def drop(self, staged: Staged) -> None:
        self._delete(f"rows/{staged.build}")
        self._delete(f"aside/{staged.build}")

    def take(self, staged: Staged, generation_id: str, generated_at: str, max_age_minutes: int = 70) -> None:
        """Makes a generation of a staged build; raises where the id is taken."""
        at = F.lit(generated_at).cast("timestamp")
        pairs = [F.lit(x) for name, n in staged.figures.items() for x in (name, n)]
        row = self.spark.range(1).select(
            F.lit(generation_id).alias("generation_id"), F.lit(staged.build).alias("build"), F.lit(staged.rows).cast("long").alias("row_count"), at.alias("generated_at"),
            F.timestamp_micros(F.unix_micros(at) + max_age_minutes * 60_000_000).alias("expires_at"), F.lit(staged.revision).alias("revision"),
            F.create_map(*pairs).cast("map<string, bigint>").alias("figures"),
        )
        try:
            row.coalesce(1).write.parquet(f"{self.root}/aside/{staged.build}")
            self._fs.mkdirs(self._path(f"{self.root}/manifest"))
            if not self._take(f"aside/{staged.build}", f"manifest/of={generation_id}"):
                raise ValueError(f"generation {generation_id} was published meanwhile")
        except Exception:
            self.drop(staged)
            raise
        self.retire()

    def publish(self, board: DataFrame, generation_id: str, generated_at: str, max_age_minutes: int = 70, most_rows: int | None = None, block_bytes: int | None = None, figures: dict[str, Column] | None = None, refusals: Callable[[Staged], list[str]] | None = None) -> int:
        """Rows published. Raises, and leaves what was there, where the id is taken, where rows are
        none, too many, or have no or repeated ids, or where ``refusals`` names reasons."""
        if self._there(f"manifest/of={generation_id}"):
            raise ValueError(f"generation {generation_id} is there already")
        staged = self.stage(board, figures, most_rows, block_bytes)
        faults = staged.faults + (refusals(staged) if refusals else [])
        if faults:
            self.drop(staged)
            raise ValueError(f"generation {generation_id} isn't whole: {', '.join(faults)}")
        self.take(staged, generation_id, generated_at, max_age_minutes)
        return staged.rows

    def retire(self, orphan_hours: float = 24) -> None:
        """Keeps the newest generations, and removes old folders that no entry names."""
        entries = self.manifest().orderBy(F.desc("generated_at"), F.desc("generation_id"))
        named = {m.build for m in entries.limit(KEPT).collect()}
        for old in entries.offset(KEPT).collect():  # as many as were published since the last time
            self._delete(f"manifest/of={old.generation_id}")
            self._delete(f"rows/{old.build}")
        before = self.spark.sparkContext._jvm.System.currentTimeMillis() - orphan_hours * 3_600_000
        for folder in ("rows", "aside"):
            for status in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if self._there(folder) else ():
                build = status.getPath().getName()
                if build not in named and status.getModificationTime() < before:
                    self._delete(f"{folder}/{build}")

    def manifest(self) -> DataFrame:
        columns = T.StructType.fromDDL(MANIFEST)
        if not self._there("manifest"):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.root}/manifest").select(*columns.names)

    def read(self, schema, now: Column) -> DataFrame | None:
        """The newest generation whose files are there and have as many rows as its entry says,
        with ``stale``; None where there is none."""
        for m in self.manifest().orderBy(F.desc("generated_at"), F.desc("generation_id")).limit(KEPT).collect():
            if not self._there(f"rows/{m.build}"):
                continue
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/rows/{m.build}")
            if rows.count() == m.row_count:
                return rows.withColumn("stale", F.lit(m.expires_at) <= now)
        return None


def lookup(board: DataFrame, ident: str) -> DataFrame:
    """The lot with this id or external id; pushed down to the files, of which the row groups
    that their statistics and bloom filters rule out aren't read."""
    known = [F.col(c) == ident for c in IDS if c in board.columns]
    return board.filter(known[0] if len(known) == 1 else known[0] | known[1])
