"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass 1 tokenizes each partition once and keeps, with every document, the tokens before it in its
partition; this goes to a table in the shared folder, so a lost executor can't change an offset.  A prefix
sum over the partitions' totals (one row a partition, the only thing that is broadcast) turns these into
global offsets.  Pass 2 cuts each document at the multiples of the window: a document that crosses a
boundary gets one record on either side.  No row moves between partitions.

Only the stream's last window is shorter than the others; ``sequences`` pads it.

Defined results: a null text counts as empty, and an empty text is one piece that holds the end token
alone; a very long text is cut into as many pieces as it crosses windows; repeated rows and equal or null
ids are packed one by one; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surmise.llm._shared import ship_code, sliced, written
from surmise.llm.bpe import ID, NativeBpe, small_batches, tokenizer

WINDOW, END_ID = 2048, 1


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids): written once; ``before`` counts the tokens before a document in its part."""
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = tokenizer(path, NativeBpe), TaskContext.get().partitionId()

        def rows():
            before = 0
            for b in sliced(batches):
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(t) + end
                    n = len(ids) // ID.itemsize
                    yield part, before, key, n, ids
                    before += n

        return small_batches(rows(), schema, 4)

    ship_code(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return written(rows.mapInArrow(run, "part int, before long, doc_id long, doc_tokens long, ids binary"), "tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``at``, each document's place in the whole stream."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", base.alias("base"))
    return tokens.join(F.broadcast(parts), "part").withColumn("at", F.col("base") + F.col("before"))


def pieces(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) for every piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in sliced(batches):
                for key, at, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(n - start, window - offset)
                        yield key, start, length, ids[start * ID.itemsize : (start + length) * ID.itemsize], n, sequence, offset
                        start += length

        return small_batches(rows(), schema, 3)

    return placed.select("doc_id", "at", "doc_tokens", "ids").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every piece of every document of ``docs``."""
    return pieces(with_offsets(tokenized(docs, path, end_id, text, doc_id)), window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole windows, the last one padded.  A group is at most one window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], ID).tobytes().hex()), (window - F.col("n_tokens")).cast("int")))
    return out.withColumn("ids", F.concat("ids", pad))
