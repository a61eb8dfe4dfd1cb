"""N-gram Jaccard join: MinHash bands find candidate texts, full n-gram sets decide.

Band and row counts follow from the similarity, the target recall and a bound on the number of hashes.
Texts are the unit: rows with equal words (white space aside) are copies of one text, known by a digest of
those words, and are never paired.  Bands shuffle as (band hash, digest).

In each band bucket every text is first verified against one leader (the text that meets most others over
all bands), which also gives the n-grams that only one of the two has.  Any two texts that met one leader are
then compared by these differences, which decide exactly as the full sets do: both lack what either lacks of
the leader, and share of their other n-grams what their differences share (differences are kept as 64-bit
hashes).  The texts of a leader are dealt in blocks of about ``BLOCK`` (fewer if they differ much), and two blocks at a time are compared
within a task, so no row is made per pair; the work still grows with the square of a group of near copies.

Result: one row per document with ``class_id`` (the smallest doc_id of its component), ``n_links`` (all other
documents that are similar to it: rows of similar texts, and the other copies of its text) and ``digest``.

Defined results: null and empty texts, and texts without a word, are copies of each other and link to
nothing else; a text of fewer than n words has one n-gram, all its words; very long texts take part with
all their n-grams; rows with equal or null ids take part row by row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import bit_filter, drop_table, may_hold, ship_code, sliced, written
from surmise.llm.components import components

WORDS, SIMILARITY, RECALL, MAX_HASHES = 5, 0.8, 0.995, 192
SPACE = r"[\x20\x09-\x0D]+"
CHUNK, FACTOR, COLUMNS = 1 << 16, np.uint64(0x9E3779B97F4A7C55), 4096
#: A block holds about so many texts of a leader, and so many of their hashes, at most; a leader's texts go to so many tasks.
BLOCK, BLOCK_HASHES, SPREAD = 256, 250_000, 64
#: So many texts at a time become Python objects.
SLICE = 64


def band_counts(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band (fewest false candidates) that reach the recall at the similarity itself."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = 1
        while bands * rows <= max_hashes and 1 - (1 - similarity**rows) ** bands < recall:
            bands += 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches that recall with so few hashes")
    return best


def joined_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def digest(words: Column) -> Column:
    return F.unhex(F.md5(words.cast("binary")))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * CHUNK - 1, FACTOR, np.uint64)]))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * CHUNK - 1, pow(int(FACTOR), -1, 1 << 64), np.uint64)]))
    return up, down


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose words are joined by single spaces."""
    up, down = _powers()
    out, at = [], 0
    while at < len(text):
        stop = text.rfind(b" ", at, at + CHUNK) if len(text) - at > CHUNK else len(text)
        if stop < 0:  # a word longer than a chunk
            stop = text.find(b" ", at)
            stop = len(text) if stop < 0 else stop
            if stop - at > CHUNK:
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:stop])], np.uint64))
                at = stop + 1
                continue
        code = np.frombuffer(text, np.uint8, stop - at, at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((code + np.uint64(1)) * up[: len(code)])])
        space = np.flatnonzero(code == 32)
        first, last = np.concatenate([[0], space + 1]), np.concatenate([space, [len(code)]])
        h = (sums[last] - sums[first]) * down[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
        at = stop + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngram_hashes(text: bytes, n: int) -> np.ndarray:
    """32-bit hashes of the word n-grams, repeats included; none of a text of fewer words."""
    h = word_hashes(text)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=4)
def _coefficients(hashes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, (hashes, 1), np.uint32) | np.uint32(1), rng.integers(0, 2**32, (hashes, 1), np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _coefficients(bands * rows)
    least = np.full(bands * rows, np.uint32(2**32 - 1))
    for at in range(0, len(grams), 512):  # a piece that stays in the processor's cache
        part = grams[at : at + 512] * a
        part += b
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(texts: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(digest, bands) of (digest, words); texts of fewer than n words can only equal copies and get no row."""
    schema = pa.schema([("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, SLICE):
            keys, found = [], []
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(grams := ngram_hashes(text, n)):
                    keys.append(key)
                    found.append(band_hashes(grams, bands, rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return texts.select("digest", F.col("words").cast("binary")).mapInArrow(run, "digest binary, bands array<long>")


def ngram_set(text: bytes, n: int) -> frozenset[bytes]:
    words = text.split()
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, both, na, nb, apart) of each pair (text, leader): sizes of the n-gram sets and of what they share.

    ``apart``: hashes of the n-grams that only one of the two has.  ``texts``: (digest, words), one row a digest.
    A leader's texts are spread over up to SPREAD tasks; each gets the leader's own text once, in front of them.
    """
    types = {"a": pa.binary(), "b": pa.binary(), "both": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "apart": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: frozenset = frozenset()
        for batch in sliced(batches, SLICE):
            rows = []
            for b, a, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = ngram_set(text, n)
                if a is None:
                    grams = own
                    continue
                apart = own ^ grams
                rows.append((a, b, len(own & grams), len(own), len(grams), np.fromiter(map(xxhash.xxh3_64_intdigest, apart), np.uint64, len(apart)).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    words = texts.select(F.col("digest").alias("d"), F.col("words").cast("binary").alias("words"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(SPREAD)))
    followers = dealt.join(words, F.col("a") == F.col("d")).select("b", "part", "a", "words")
    leaders = dealt.select("b", "part").distinct().join(words, F.col("b") == F.col("d")).select("b", "part", F.lit(None).cast("binary").alias("a"), "words")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaders.unionByName(followers).repartition(tasks, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.select("b", "a", "words").mapInArrow(run, "a binary, b binary, both long, na long, nb long, apart array<long>")


def enough(both: Column, na: Column, nb: Column, similarity: float) -> Column:
    """Whether ``both`` shared n-grams make sets of these sizes similar, in whole numbers."""
    least = Fraction(str(similarity))
    return (both > 0) & (both * least.denominator >= least.numerator * (na + nb - both))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets have in common."""
    out = np.zeros((len(sets), len(sets)))
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1  # others are in one set only
    owner, keep = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), common[member]
    owner, member = owner[keep], (np.cumsum(common) - 1)[member[keep]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    total = int(common.sum())
    for at in range(0, total, COLUMNS):  # bounded memory for many members
        low, high = np.searchsorted(member, [at, at + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, total - at)), np.float32)
        x[owner[low:high], member[low:high] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def similar_in(rows: list[dict], similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of texts that met one leader: for each, the rows of similar texts; and pairs that join the components (``root``).

    Texts of one block are compared with those of the other, or with each other if there is one block only.
    A pair counts under the smallest leader that both met.
    """
    least = Fraction(str(similarity))
    column = lambda name: np.array([r[name] for r in rows])
    n, lost, block = column("n"), column("lost"), column("block")
    both = rows[0]["size"] - lost[:, None] - lost + shared([r["apart"] for r in rows])
    found = (both > 0) & (both * least.denominator >= least.numerator * (n[:, None] + n - both))
    found &= (block[:, None] != block) if rows[0]["i"] != rows[0]["j"] else ~np.eye(len(rows), dtype=bool)

    number: dict[bytes, int] = {}
    before = [np.array([number.setdefault(x, len(number)) for x in r["leaders"] if x < r["leader"]], np.int64) for r in rows]
    weights = (found & (shared(before) == 0)) @ column("copies")

    _, root = np.unique(np.array([r["root"].hex() for r in rows]), return_inverse=True)
    above, joins = list(range(len(rows))), []

    def top(x: int) -> int:
        while above[x] != x:
            x = above[x]
        return x

    at = np.argwhere(found & (root[:, None] < root))
    _, first = np.unique(root[at[:, 0]] * len(rows) + root[at[:, 1]], return_index=True)
    for a, b in at[first].tolist():
        x, y = top(int(root[a])), top(int(root[b]))
        if x != y:
            above[x] = y
            joins.append((a, b))
    return weights, joins


def counted(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, weight): for each text and block, the ``weight`` of similar texts (b null), and links between components.

    ``rows``: (leader, digest, size, n, lost, apart, leaders, copies, root, blocks), one for each leader of a text.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("weight", pa.int64())])
    names = ("leader", "i", "j", "block", "digest", "size", "n", "lost", "leaders", "copies", "root")

    def judged(held: list[dict]) -> Iterator[tuple]:
        if len(held) > 1:
            weights, joins = similar_in(held, similarity)
            yield from ((held[k]["digest"], None, int(w)) for k, w in enumerate(weights) if w)
            yield from ((held[a]["digest"], held[b]["digest"], 0) for a, b in joins)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)] if found else [pa.array([], t) for t in schema.types], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found, columns = [], [c.to_pylist() for c in batch.columns[:-1]]
            apart = batch.columns[-1]
            values, ends = apart.values.to_numpy(), apart.offsets.to_numpy()
            for k, r in enumerate(zip(*columns, strict=True)):
                if r[:3] != key:
                    found += judged(held)
                    key, held = r[:3], []
                held.append(dict(zip(names, r, strict=True)) | {"apart": values[ends[k] : ends[k + 1]].copy()})
            yield batch_of(found)
        yield batch_of(list(judged(held)))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*names, "apart")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "a binary, b binary, weight long")


def links(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, max_hashes: int = MAX_HASHES, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, links, degrees): (doc_id, digest) of every row, verified links (a, b) between digests that
    make the components, and (a, links) with the rows of all texts that are similar to a."""
    spark = docs.sparkSession
    ship_code(spark)
    bands, rows = band_counts(similarity, recall, max_hashes)
    all_rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), joined_words(F.col(text)).alias("words"))
    all_rows = all_rows.withColumn("digest", digest(F.col("words")))
    members = written(all_rows.select("doc_id", "digest"), "members")
    one = members.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)))
    signed = written(signatures(all_rows, bands, rows, n).groupBy("digest").agg(F.first("bands").alias("bands")), "signatures")

    banded = signed.select("digest", F.explode("bands").alias("band"))
    # what is counted of a band is written before it is joined, so that Spark can split a hot band
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("k"), "n"), "bands")
    met = written(banded.join(shared, F.col("band") == F.col("k")).select("band", "digest", "n"), "buckets")
    drop_table(spark, signed)
    drop_table(spark, shared)
    # the text that meets most others over all its bands: of copies of one text, likely the text itself
    known_by = met.groupBy("digest").agg(F.sum("n").alias("met")).select(F.col("digest").alias("d"), "met")
    lead = met.join(known_by, F.col("digest") == F.col("d")).groupBy("band").agg(F.max(F.struct("met", "digest")).alias("m")).select(F.col("band").alias("k"), F.col("m.digest").alias("first"))
    lead = written(lead, "leaders")
    buckets = written(met.join(lead, F.col("band") == F.col("k")).select("band", "digest", "first"), "buckets")
    drop_table(spark, met)
    drop_table(spark, lead)
    # each text is fetched once, from the copy with the smallest id, so a hot text moves as one row
    want = written(buckets.select("digest").distinct().join(one, "digest").select(known("doc_id").alias("rep"), F.col("digest").alias("d")), "wanted")
    bitmaps, bits = bit_filter(want, "d")
    likely = may_hold(all_rows, "digest", bitmaps, bits).where("may_hold").drop("may_hold")
    texts = likely.join(want, (known("doc_id") == F.col("rep")) & (F.col("digest") == F.col("d")), "left_semi")
    texts = written(texts.dropDuplicates(["digest"]).select("digest", "words"), "texts")
    drop_table(spark, want)
    drop_table(spark, bitmaps)

    led = written(compared(buckets.where("digest != first").select(F.col("digest").alias("a"), F.col("first").alias("b")).distinct(), texts, n), "led")
    similar = enough(F.col("both"), F.col("na"), F.col("nb"), similarity)
    found = written(led.where(similar).select("a", "b"), "links")
    roots = components(found)

    # every text under each of its leaders, and the leaders under themselves
    own = led.groupBy("b").agg(F.first("nb").alias("nb")).select(F.col("b").alias("leader"), F.col("b").alias("digest"), F.col("nb").alias("size"), F.col("nb").alias("n"), F.lit(0).cast("long").alias("lost"), F.array().cast("array<long>").alias("apart"))
    placed = led.select(F.col("b").alias("leader"), F.col("a").alias("digest"), F.col("nb").alias("size"), F.col("na").alias("n"), (F.col("nb") - F.col("both")).alias("lost"), "apart").unionByName(own)
    size = F.greatest(F.count("*") / BLOCK, F.sum(F.size("apart")) / BLOCK_HASHES)
    blocks = written(placed.groupBy("leader").agg(F.ceil(size).alias("blocks")).select(F.col("leader").alias("k"), "blocks"), "blocks")
    known_of = placed.groupBy("digest").agg(F.collect_set("leader").alias("leaders")).join(members.groupBy("digest").agg(F.count("*").alias("copies")), "digest")
    known_of = known_of.join(roots, F.col("digest") == F.col("node"), "left").select(F.col("digest").alias("d"), "leaders", "copies", F.coalesce("root", "digest").alias("root"))
    pairs = written(counted(placed.join(blocks, F.col("leader") == F.col("k")).join(known_of, F.col("digest") == F.col("d")), similarity), "pairs")
    degrees = pairs.where("b is null").groupBy("a").agg(F.sum("weight").alias("links"))
    for table in (buckets, texts, led, blocks):
        drop_table(spark, table)
    return members, found.unionByName(pairs.where("b is not null").select("a", "b")), degrees


def classes(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, max_hashes: int = MAX_HASHES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links, digest, root) for every row of ``docs``; ``root`` is the same digest throughout a class."""
    members, pairs, degree = links(docs, similarity, n, recall, max_hashes, text, doc_id)
    roots = components(pairs)
    copies = members.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    placed = copies.join(roots, F.col("digest") == F.col("node"), "left").join(degree, F.col("digest") == F.col("a"), "left")
    placed = written(placed.select("digest", "low", F.coalesce("root", "digest").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    smallest = written(placed.groupBy("root").agg(F.min("low").alias("class_id")), "smallest")
    known = placed.join(smallest, "root").select(F.col("digest").alias("d"), "class_id", "n_links", "root")
    return members.join(known, F.col("digest") == F.col("d")).select("doc_id", "class_id", "n_links", "digest", "root")
