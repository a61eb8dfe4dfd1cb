"""Byte-level BPE, encoded with a priority queue of merge ranks and decoded by joining vocabulary strings.

``ByteBpe`` reads a ``tokenizer.json`` file (its path is a parameter) and gives the ids that the tokenizers
library gives with ``add_special_tokens=False``.  A file with settings that aren't supported (a normalizer, another
pre-tokenizer or decoder, word ends, byte fallback, added tokens that take white space along) is a ValueError.

A piece of text that the pre-tokenizer's pattern cuts out becomes a doubly linked list of byte symbols.
All mergeable neighbours wait in a heap as (rank, position); the lowest rank merges first, of equal ranks
the leftmost.  An entry whose symbols have changed since it was pushed is stale and is skipped.  A piece
of n bytes costs O(n log n), so one huge "word" does no harm.

Most of a text is made of pieces seen before.  A space that no white space follows always begins a new
piece, so the text is split there and the ids of each part are looked up in a bounded table; a text with
other uses of the space goes through the pattern as a whole.

Defined results: a null text counts as empty and has no ids; very long texts are encoded whole; repeated
rows, equal and null ids are encoded row by row; empty tables give empty results; ids that aren't in
the vocabulary make decoding fail.  ``encode``, ``decode`` and ``round_trip`` return their key and output
columns only, so extra columns can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import ship_code, sliced

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts as PATTERN does, without trying shorter runs again: a run that ends the text is one piece at once.
NATIVE_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A generation of the table of pieces has so many entries, of other tables fewer; longer texts aren't kept.
TABLE_ENTRIES, TABLE_CHARS = 500_000, 48
#: A batch is passed on once it holds so many bytes.
BATCH_BYTES = 8_000_000
ID = np.dtype("<u4")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def settings(spec: dict) -> bool:
    """Whether texts get a space in front; raises if the file asks for what isn't supported."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = {
        "normalizer": spec.get("normalizer"),
        "pre-tokenizer": pre.get("type") != "ByteLevel" or not pre.get("use_regex", True),
        "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "model": model.get("type", "BPE") != "BPE",
        **{k: model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        "added tokens": any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word")),
    }
    if found := [k for k, v in odd.items() if v]:
        raise ValueError(f"the tokenizer file's {', '.join(found)} isn't supported")
    return bool(pre.get("add_prefix_space"))


class _OtherSpace(Exception):
    """A space that white space, another space or the end of the text follows."""


class _Table(dict):
    """Ids (as bytes) of text parts seen before, in two generations: a full one becomes the old one, and what is
    found there moves on to the new one, so that frequent parts stay."""

    def __init__(self, make, prefix: str, entries: int):
        self.make, self.prefix, self.entries, self.old = make, prefix, entries, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if self.prefix and (not part or part[0].isspace()):
                raise _OtherSpace
            ids = self.make(self.prefix + part)
        if len(part) <= TABLE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.space_first = settings(spec)
        vocab, byte = spec["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): i for i, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.symbol = [0] * 256
        for letter, b in byte.items():
            self.symbol[b] = vocab[letter]
        self.strings = vocabulary_strings(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.after_space, self.at_start = _Table(self._pieces, " ", TABLE_ENTRIES * 3 // 5), _Table(self._pieces, "", TABLE_ENTRIES // 5)
        self.piece = _Table(self._merged, "", TABLE_ENTRIES)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-tokenized piece."""
        ids, rank, merges = [self.symbol[b] for b in piece], self.rank.get, self.merges
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank * n + position sorts by rank, then from the left
        queue = [r * n + i for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapify(queue)
        while queue:
            r, i = divmod(heappop(queue), n)
            left, right, merged = merges[r]
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((merged, ids[k]))) is not None:
                    heappush(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank((ids[h], merged))) is not None:
                heappush(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def _merged(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), ID).tobytes()

    def _pieces(self, part: str) -> bytes:
        found = self.pattern.findall(part)
        return self.piece[found[0]] if len(found) == 1 else b"".join(map(self.piece.__getitem__, found))

    def _ordinary(self, text: str) -> bytes:
        if self.space_first and not text.startswith(" "):
            text = f" {text}"
        first, *rest = text.split(" ")
        try:
            return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))
        except _OtherSpace:
            return self._pieces(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut or not any(s in text for s in self.special):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._ordinary(text[at : m.start()]) if m.start() > at else b"", np.array([self.special[m[0]]], ID).tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:]) if at < len(text) else b""])

    def decode(self, ids: bytes) -> str:
        return joined(ids, self.strings)


class NativeBpe(ByteBpe):
    """The same ids for operators that only need ids: whole texts go to a compiled library, without tables.

    That library ranks merges by the id of what they make, so the vocabulary must be ordered by merges.
    """

    def __init__(self, path: str):
        super().__init__(path)
        first = self.merges[0][2] if self.merges else 0
        if any(made != first + i for i, (_, _, made) in enumerate(self.merges)):
            raise ValueError("the vocabulary's ids don't follow the order of its merges; use ByteBpe")
        ranks = {string: i for i, string in self.strings.items() if i not in self.special.values()}
        self.library = tiktoken.Encoding("from-file", pat_str=NATIVE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ordinary(self, text: str) -> bytes:
        if self.space_first and not text.startswith(" "):
            text = f" {text}"
        return self.library.encode_to_numpy(text, disallowed_special=()).astype(ID, copy=False).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, kind: type[ByteBpe] = ByteBpe) -> ByteBpe:
    """One tokenizer a process, so that its tables last over batches and tasks."""
    return kind(path)


@lru_cache(maxsize=2)
def vocabulary_strings(path: str) -> dict[int, bytes]:
    """id -> bytes, all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = byte_letters()
    strings = {i: bytes(byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in byte for c in s)}
    return strings | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def joined(ids: bytes, strings: dict[int, bytes]) -> str:
    """The text of little-endian 32-bit ids; bytes that aren't UTF-8 become replacement characters."""
    return b"".join(map(strings.__getitem__, np.frombuffer(ids, ID).tolist())).decode("utf-8", "replace")


def small_batches(rows: Iterable[tuple], schema: pa.Schema, *weights: int) -> Iterator[pa.RecordBatch]:
    """Record batches of ``rows``, each ended once the values in the columns ``weights`` reach BATCH_BYTES."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(row[w]) for w in weights) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): ids as the bytes of little-endian unsigned 32-bit integers."""
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        rows = ((k, len(ids) // 4, ids) for b in sliced(batches) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for ids in [bpe.encode(t)])
        return small_batches(rows, schema, 2)

    ship_code(docs.sparkSession)
    out = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key long, n_tokens long, ids binary")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", keep: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """(key, *keep, text) of a frame with the column ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary_strings(path)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([joined(x or b"", strings) for x in b.columns[-1].to_pylist()], pa.string())], names=[*b.schema.names[:-1], "text"])

    ship_code(encoded.sparkSession)
    types = dict(encoded.dtypes)
    columns = [key, *keep]
    return encoded.select(*columns, F.col("ids").alias("text")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ``encode`` and ``decode`` of its ids in one worker, so that ids don't travel in between."""
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)

        def rows():
            for b in sliced(batches):
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(t)
                    yield k, len(ids) // ID.itemsize, ids, bpe.decode(ids)

        return small_batches(rows(), schema, 2, 3)

    ship_code(docs.sparkSession)
    out = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key long, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("key", key)
