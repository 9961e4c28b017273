"""Operator 5, exact dedup: a log-structured merge index of text digests.

Memtable: a task of a flush holds the digests of its range; equal ones are merged where they are read, and again in the memtable.
Flush: memtables are written in the order of the digest, a sorted run on level 0, beside it a filter of its digests. Compaction: when a level has
`FANOUT` runs they are merged into one of the next level; of equal digests the smallest identifier stays, and counts add up. Filters are asked first: a digest that no other run may have
goes over as it is, and only the others meet in a shuffle. Look-up: a run is read only if its filter lets a digest through.
Hits, that is rows whose digest more than one row has, are compared byte by byte with the row that stays: their texts alone are moved,
told from all others by a filter that each task consults before the shuffle. Groups of copies are dealt out in parts of `PART` rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import BLANKS, P, shared_folder, stored, text_of
from tracewright.llm.filters import Filter

DIGEST, FIRST, ROWS, NORMAL, KEEP, MET = (f"{P}{x}" for x in ("digest", "first", "rows", "normal", "keep", "met"))
#: Runs of a level that are merged into one of the next; batches that a corpus is flushed in; rows of a group that a task compares.
FANOUT, BATCHES, PART = 4, 4, 10_000


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Run(NamedTuple):
    rows: DataFrame
    filter: Filter


class DigestIndex:
    """Runs of (digest, smallest identifier, rows) under `path`, by level; the files of each are sorted, and beside it lies a filter of its digests."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.levels: list[list[Run]] = [[]]

    def _write(self, merged: DataFrame, level: int) -> Run:
        name = uuid.uuid4().hex
        merged.sortWithinPartitions(DIGEST).write.parquet(f"{self.path}/level{level}/run-{name}")
        rows = self.spark.read.schema(merged.schema).parquet(f"{self.path}/level{level}/run-{name}")
        return Run(rows, Filter(rows, DIGEST).keep(f"{self.path}/level{level}/filter-{name}"))

    def flush(self, rows: DataFrame) -> None:
        """Merge rows (digest, identifier as a struct that sorts smallest first) in memtables and write them as a run of level 0; merge full levels."""
        self.levels[0].append(self._write(rows.groupBy(DIGEST).agg(F.min(FIRST).alias(FIRST), F.count("*").alias(ROWS)), 0))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        marked = None
        for run in self.levels[level]:
            rows = run.rows.withColumn(MET, F.lit(False))
            for other in self.levels[level]:
                if other is not run:
                    rows = other.filter.marked(rows, f"{P}may", DIGEST).withColumn(MET, F.col(MET) | F.col(f"{P}may")).drop(f"{P}may")
            marked = rows if marked is None else marked.unionByName(rows)
        if level + 1 == len(self.levels):
            self.levels.append([])
        met = marked.where(MET).groupBy(DIGEST).agg(F.min(FIRST).alias(FIRST), F.sum(ROWS).alias(ROWS))
        self.levels[level + 1].append(self._write(marked.where(f"NOT {MET}").drop(MET).unionByName(met), level + 1))
        self.levels[level] = []

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(digest, smallest identifier, rows) of those digests of `keys` that the index holds; a run whose filter lets none of them through is not read."""
        asked = [(run, run.filter.may_hold(keys.select(DIGEST), DIGEST)) for run in self.runs()]
        found = None
        for run, some in asked:
            if not some.isEmpty():
                part = run.rows.join(some.distinct().hint("merge"), DIGEST, "left_semi")
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.runs()[0].rows.limit(0)
        return found.groupBy(DIGEST).agg(F.min(FIRST).alias(FIRST), F.sum(ROWS).alias(ROWS))

    def merged(self) -> DataFrame:
        """All levels as one run: each digest once, with its smallest identifier and its rows."""
        while len(self.runs()) > 1:
            self._compact(next(k for k, runs in enumerate(self.levels) if runs))
        return self.runs()[0].rows


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batches: int = BATCHES, part: int = PART) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; null counts as empty, and empty texts equal each other.
    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id; a null doc_id counts as
    larger than any other. Repeated rows with the same doc_id and length cannot be told apart: each says kept. Only doc_id and text are read, so
    other columns may have any name. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    first = F.struct((-F.length(text)).alias("longest"), docs["doc_id"].isNull().alias("unknown"), docs["doc_id"].alias("doc_id"))
    # texts are read twice, here for their digests and below for those of hits; the mark tells texts of one doc_id apart
    rows = docs.select(first.alias(FIRST), F.xxhash64(text).alias(f"{P}mark"), normalised(text).alias(NORMAL))
    keys = stored(rows.select(FIRST, f"{P}mark", digest(F.col(NORMAL)).alias(DIGEST)), "digests")
    index = DigestIndex(spark, f"{shared_folder(spark)}/tracewright/digest-index-{uuid.uuid4().hex}")
    for k in range(batches):
        index.flush(keys.where(F.pmod(F.xxhash64(f"{FIRST}.doc_id", FIRST), F.lit(batches)) == k).select(DIGEST, FIRST))
    level = index.merged()
    single = level.where(f"{ROWS} = 1").select(
        F.col(f"{FIRST}.doc_id").alias("doc_id"), F.col(f"{FIRST}.doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), DIGEST,
    )
    several = level.where(f"{ROWS} > 1").select(DIGEST, F.col(FIRST).alias(KEEP), ROWS)
    hit = Filter(several, DIGEST)
    # digests of which there is one row stay where they are
    known = hit.may_hold(keys, DIGEST).join(several.hint("merge"), DIGEST).select(F.col(FIRST).alias(f"{P}own"), F.col(f"{P}mark").alias(f"{P}own_mark"), F.col(DIGEST).alias(f"{P}own_digest"), KEEP, ROWS)
    texts = hit.may_hold(rows.withColumn(DIGEST, digest(F.col(NORMAL))), DIGEST)
    same = (F.col(FIRST) == F.col(f"{P}own")) & (F.col(f"{P}mark") == F.col(f"{P}own_mark")) & (F.col(DIGEST) == F.col(f"{P}own_digest"))
    # doc_ids, not digests, deal out the texts of hits; a row that repeats another in all that is read is one
    hits = stored(texts.join(known.distinct().hint("merge"), same).select(DIGEST, FIRST, KEEP, ROWS, NORMAL), "hits")
    models = hits.where(F.col(FIRST) == F.col(KEEP)).groupBy(DIGEST).agg(F.min(NORMAL).alias(f"{P}model"), F.max(ROWS).alias(ROWS))
    parts = F.ceil(F.col(ROWS) / part)
    spread = models.select(DIGEST, f"{P}model", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias(f"{P}part"))
    compared = hits.withColumn(f"{P}part", F.pmod(F.xxhash64(FIRST), parts)).join(spread.hint("merge"), [DIGEST, f"{P}part"])
    compared = stored(compared.withColumn(f"{P}equal", F.col(NORMAL) == F.col(f"{P}model")).select(DIGEST, FIRST, KEEP, ROWS, f"{P}equal", F.when(~F.col(f"{P}equal"), F.col(NORMAL)).alias(NORMAL)), "compared")
    row = lambda keep: [F.col(f"{FIRST}.doc_id").alias("doc_id"), F.col(f"{keep}.doc_id").alias("keep_id"), "group_size", (F.col(FIRST) == F.col(keep)).alias("kept"), DIGEST]
    verified, other = compared.where(f"{P}equal").drop(NORMAL), compared.where(~F.col(f"{P}equal"))
    if other.isEmpty():
        every = single.unionByName(verified.withColumnRenamed(ROWS, "group_size").select(*row(KEEP)))
    else:  # texts that a digest threw together with others form groups of their own
        groups = other.groupBy(DIGEST, NORMAL).agg(F.min(FIRST).alias(f"{P}keep2"), F.count("*").alias("group_size"))
        strayed = stored(other.groupBy(DIGEST).agg(F.count("*").alias(f"{P}strayed")), "strayed")
        left = verified.join(strayed.hint("merge"), DIGEST, "left").withColumn("group_size", F.col(ROWS) - F.coalesce(f"{P}strayed", F.lit(0)))
        apart = other.join(stored(groups, "groups").hint("merge"), [DIGEST, NORMAL])
        every = single.unionByName(left.select(*row(KEEP))).unionByName(apart.select(*row(f"{P}keep2")))
    if digest is sha256:
        return every.withColumn("text_sha256", F.lower(F.hex(DIGEST))).drop(DIGEST)
    return every.withColumn("text_sha256", F.lit(None).cast("string")).drop(DIGEST)
