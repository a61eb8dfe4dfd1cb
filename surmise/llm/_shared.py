"""Helpers shared by the operators: the cluster's shared folder, written tables, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: weakref.WeakSet = weakref.WeakSet()
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only on one machine (tests), a temporary one may stand in."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="surmise-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/surmise-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    _folders.append(path)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has made so far: for when their results have been read."""
    while _folders:
        _delete(spark, _folders.pop())


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, folder)


#: A filter has at most so many bits: 8 MB, whatever the input, so it may be broadcast.
FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(bitmaps, bits): a one-hash Bloom filter of ``keys``, in bitmaps of 4 KB; 16 bits a key up to FILTER_BITS.

    With more keys more others pass, up to all of them: a filter only saves work, it never decides.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    found = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return written(found.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "filter"), bits


def may_hold(rows: DataFrame, column: str, bitmaps: DataFrame, bits: int, flag: str = "may_hold") -> DataFrame:
    """``rows`` with a flag: false only where ``column`` isn't among the filter's keys.  The filter's size is bounded, so it is broadcast."""
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    f = bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    found = rows.join(F.broadcast(f), F.bitmap_bucket_number(at) == F.col("__bucket"), "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bitmap", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return found.withColumn(flag, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bitmap")


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, so that Arrow functions can be imported there by name."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="surmise-"), "surmise.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only some rows at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def passed_on(docs: DataFrame, keep: Sequence[str] | None, made: Iterable[str]) -> tuple[DataFrame, str]:
    """(the columns that an Arrow function passes on, their types): all but those that it makes, or those in ``keep``."""
    kept = docs.drop(*made) if keep is None else docs.select(*keep)
    return kept, ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(column: str, divisor: int):
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
