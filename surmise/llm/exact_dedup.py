"""Exact dedup over a log-structured merge index of text digests.

``LsmIndex`` holds runs of (digest, keep_id, copies), each sorted by digest, as Parquet files with Bloom filters.

* ``flush`` takes a batch in: every task is a memtable, which it writes as sorted runs of ``memtable_rows`` rows at
  most.  Nothing moves between tasks.  The runs of one batch are a segment of level 0.
* ``compact`` is size-tiered: a level with ``FANOUT`` segments is merged into one segment of the next level, in
  which the smallest identifier of equal digests stays and the copies add up.  ``compact(full=True)`` merges all.
* Each segment has a filter, a bitmap of bounded size; ``lookup`` reads a segment for those digests only that its
  filter lets pass, and skips segments for which none is left.
* Hits receive byte verification: the texts of hits are grouped by their own bytes, so two texts that share a
  digest stay apart.

``dedup`` flushes a table, compacts it fully, and makes a filter of the digests seen more than once.  A row that
the filter excludes is the only one of its text and is done; only the others are looked up, and only their texts
are moved and verified.

Texts are equal when identical after each run of white space ``[\\x20\\x09-\\x0D]+`` becomes one space; a
null text counts as empty.  A hot text can't overload a task: copies are combined before every exchange, and
joins with hits are salted by identifier.

Defined results: rows with one id and equal texts count as copies of each other and get equal results
(``kept`` is true for each of them if that id is the smallest); a null id never wins against another id,
and in a group of null ids only, ``keep_id`` is null and ``kept`` true; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surmise.llm._shared import bit_filter, drop_table, may_hold, written

SPACE = r"[\x20\x09-\x0D]+"
MEMTABLE_ROWS, FANOUT, SALTS = 100_000, 8, 32
FILTERS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(MEMTABLE_ROWS)}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Segment:
    """Runs that were written together, and their filter (made when first asked for)."""

    level: int
    runs: DataFrame
    bitmaps: DataFrame | None = None
    bits: int = 0

    def filter(self) -> tuple[DataFrame, int]:
        if self.bitmaps is None:
            self.bitmaps, self.bits = bit_filter(self.runs.select("digest"), "digest")
        return self.bitmaps, self.bits

    def drop(self, spark: SparkSession) -> None:
        drop_table(spark, self.runs)
        if self.bitmaps is not None:
            drop_table(spark, self.bitmaps)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))


class LsmIndex:
    """Segments of sorted runs (digest, keep_id, copies) in the shared folder, newest last."""

    def __init__(self, spark: SparkSession, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.spark, self.memtable_rows, self.fanout = spark, memtable_rows, fanout
        self.segments: list[Segment] = []
        self.skipped = 0  # segments that lookups didn't have to read

    def flush(self, batch: DataFrame) -> Segment:
        """``batch``: (digest, doc_id).  Every task sorts what it holds and writes it as runs."""
        memtables = batch.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies")).sortWithinPartitions("digest", "keep_id")
        self.segments.append(Segment(0, written(memtables, "runs-l0", maxRecordsPerFile=str(self.memtable_rows), **FILTERS)))
        return self.segments[-1]

    def _merge(self, old: list[Segment], keep: tuple[Segment, ...] = ()) -> Segment:
        rows = old[0].runs
        for s in old[1:]:
            rows = rows.unionByName(s.runs)
        level = 1 + max(s.level for s in old)
        new = Segment(level, written(_merged(rows).sortWithinPartitions("digest"), f"runs-l{level}", **FILTERS))
        self.segments = [new, *(s for s in self.segments if s not in old)]
        for s in old:
            if s not in keep:
                s.drop(self.spark)
        return new

    def compact(self, full: bool = False, keep: tuple[Segment, ...] = ()) -> Segment:
        """Merge levels that are full, or everything; the files of what was merged go, unless it is in ``keep``."""
        if full:
            return self._merge(list(self.segments), keep)
        level = 0
        while any(s.level >= level for s in self.segments):
            here = [s for s in self.segments if s.level == level]
            if len(here) >= self.fanout:
                self._merge(here, keep)
            level += 1
        return self.segments[0]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, copies) of those of the given digests that the index holds."""
        wanted, found = digests.select("digest").distinct(), None
        for s in self.segments:
            likely = written(may_hold(wanted, "digest", *s.filter()).where("may_hold").select("digest"), "likely")
            if likely.isEmpty():
                self.skipped += 1
                continue
            hit = s.runs.join(likely, "digest", "left_semi")
            found = hit if found is None else found.unionByName(hit)
        return _merged(found) if found is not None else self.spark.createDataFrame([], "digest binary, keep_id long, copies long")

    def drop(self) -> None:
        for s in self.segments:
            s.drop(self.spark)
        self.segments = []


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def on_every_salt(hits: DataFrame) -> DataFrame:
    return hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def verified_classes(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(digest, text) of every hit, grouped by the texts' own bytes.

    ``docs``: (doc_id, text, digest).  A digest that turns out to hold several texts gives several rows.
    """
    found = salted(docs).join(on_every_salt(hits.select("digest")).hint("shuffle_hash"), ["digest", "salt"])
    return found.select("digest", "text").distinct()


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", memtable_rows: int = MEMTABLE_ROWS, digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("text"))
    rows = rows.withColumn("digest", digest_of(F.col("text")))
    index = LsmIndex(spark, memtable_rows)
    first = index.flush(rows.select("digest", "doc_id"))
    whole = index.compact(full=True, keep=(first,))
    hits = written(whole.runs.where("copies > 1"), "hits")
    bitmaps, bits = bit_filter(hits, "digest")

    texts = verified_classes(may_hold(rows, "digest", bitmaps, bits).where("may_hold"), hits).groupBy("digest").agg(F.count("*").alias("texts"))
    clashing = written(texts.where("texts > 1").select("digest"), "clashing")

    # every row is in a run of its own batch, so the texts needn't be read again
    seen = may_hold(first.runs.select("digest", F.col("keep_id").alias("doc_id")), "digest", bitmaps, bits)
    alone = seen.where("NOT may_hold").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"), "digest")
    maybe = salted(seen.where("may_hold")).join(on_every_salt(hits).hint("merge"), ["digest", "salt"], "left")
    found = maybe.select("doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("copies"), "digest")
    if not clashing.isEmpty():
        # two texts under one digest: these few rows get the answer of their own bytes
        apart = rows.join(clashing, "digest", "left_semi")
        own = apart.join(apart.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")), ["digest", "text"])
        found = found.join(clashing, "digest", "left_anti").unionByName(own.select("doc_id", "keep_id", "copies", "digest"))
    out = alone.unionByName(found)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"), "digest")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY t)
SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM t JOIN g USING (t)"""
