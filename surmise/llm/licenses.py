"""License scans: phrases found word by word, and short notices found with a bounded number of errors.

A text is lower-cased (A-Z) and reduced to its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with single spaces.
Phrases must stand there as consecutive words.  Notices may differ by up to ``ERROR_SHARE`` of their length
(rounded down, one edit at least): each is cut into two more seeds than it may have errors, so every
occurrence holds two seeds unchanged (pigeonhole) whose distance is off by no more than the errors.  One
automaton finds all seeds, and around such pairs the regex library's bounded-error matching verifies the
notice and gives its span and its edits.

Defined results: a null text counts as empty and has no words, spans or labels; very long texts are
scanned whole; overlapping places all count; repeated rows and equal or null ids are scanned row by row;
an empty table gives an empty result; extra columns stay, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import passed_on, ship_code, sliced

PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices and their labels; words as they are after normalisation.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
}
ERROR_SHARE, INTACT = 0.1, 2

_SEPARATORS = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))


def normalised_words(text: str | None) -> list[bytes]:
    """The words of a text; only A-Z change case."""
    return (text or "").encode("utf-8", "replace").lower().translate(_SEPARATORS).split()


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + INTACT pieces of nearly equal length with their places."""
    n = errors + INTACT
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: Mapping[str, str], notices: Mapping[str, str], error_share: float):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(n, label, max(1, int(len(n) * error_share))) for n, label in notices.items()]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in self.notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, k) in enumerate(self.notices):
            for at, seed in seeds(notice, k):
                places.setdefault(seed, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        if places:
            self.automaton.make_automaton()
        self.any_seed = bool(places)

    def phrase_places(self, spaced: bytes) -> list[tuple[int, str, str]]:
        """(word number, label, phrase) of every place of a phrase; ``spaced``: the words with spaces around them."""
        found = []
        for phrase, label in self.phrases:
            at, words, last, text = spaced.find(phrase), 0, 0, phrase[1:-1].decode()
            while at >= 0:
                words += spaced.count(b" ", last, at)
                last = at
                found.append((words, label, text))
                at = spaced.find(phrase, at + 1)
        return sorted(found)

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Stretches of the text that may hold a notice, merged where they overlap."""
        starts: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text) if self.any_seed else ():
            for i, offset in where:
                starts.setdefault(i, []).append((end + 1 - size - offset, offset))
        hits: dict[int, list[list[int]]] = {}
        for i, seen in starts.items():
            notice, _, k = self.notices[i]
            seen.sort()
            for j, (low, offset) in enumerate(seen):
                # another seed of the notice, about where it should be
                near = (seen[m] for m in range(j + 1, len(seen)))
                for other, place in near:
                    if other - low > k:
                        break
                    if place != offset:
                        hits.setdefault(i, []).append([max(0, low - k), min(len(text), other + len(notice) + k)])
                        break
        for found in hits.values():
            found.sort()
            merged = found[:1]
            for low, high in found[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            found[:] = merged
        return hits

    def _inexact(self, i: int, text: str, low: int, high: int) -> list[tuple[int, int, str, int, int]]:
        notice, label, k = self.notices[i]
        if high - low < len(notice) - k:
            return []
        return [(m.start(), m.end(), label, sum(m.fuzzy_counts), len(notice)) for m in self.patterns[i].finditer(text, low, high)]

    def spans(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, notice length) of every notice in a normalised text."""
        found = []
        for i, stretches in self.windows(text).items():
            notice, label, _ = self.notices[i]
            for low, high in stretches:
                # unchanged notices need no error matching, only the rest of the stretch does
                while (at := text.find(notice, low, high)) >= 0:
                    found += self._inexact(i, text, low, at)
                    found.append((at, at + len(notice), label, 0, len(notice)))
                    low = at + len(notice)
                found += self._inexact(i, text, low, high)
        return sorted(found)


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, notices: tuple, error_share: float) -> Scanner:
    return Scanner(dict(phrases), dict(notices), error_share)


KINDS = "n_words long, places array<struct<word: long, label: string, phrase: string>>, spans array<struct<start: long, stop: long, label: string, edits: int, length: int>>"
_TYPES = {
    "n_words": pa.int64(),
    "places": pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("phrase", pa.string())])),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("length", pa.int32())])),
}


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, error_share: float = ERROR_SHARE, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, places (of phrases, by word) and spans (of notices, by character of the normalised text)."""
    ship_code(docs.sparkSession)
    kept, kinds = passed_on(docs, keep, _TYPES)
    key = (tuple(phrases.items()), tuple(notices.items()), error_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for b in sliced(batches):
            counts, places, spans = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = normalised_words(t)
                joined = b" ".join(words)
                counts.append(len(words))
                places.append([{"word": w, "label": x, "phrase": p} for w, x, p in scanner.phrase_places(b" " + joined + b" ")])
                spans.append([dict(zip(("start", "stop", "label", "edits", "length"), s, strict=True)) for s in scanner.spans(joined.decode("utf-8", "replace"))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, _TYPES["n_words"]), pa.array(places, _TYPES["places"]), pa.array(spans, _TYPES["spans"])], names=[*b.schema.names[:-1], *_TYPES])

    return docs.select(*(docs[f"`{c}`"] for c in kept.columns), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, {KINDS}")


def summary(scanned: DataFrame, base: Collection[str] | None = None) -> dict[str, F.Column]:
    """Columns that sum a scan up: counts, first and last place, labels, and the best match as a score.

    With ``base``, only places of these phrases are counted and give base labels; the other phrases still label and score.
    """
    places = F.col("places") if base is None else F.filter("places", lambda p: p["phrase"].isin(*base))
    words, joined = places["word"], lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / s["length"]))
    return {
        "n_base": F.size(places).cast("long"),
        "first_word": F.array_min(words),
        "last_word": F.array_max(words),
        "base_labels": joined(places["label"]),
        "labels": joined(F.concat(F.col("places.label"), F.col("spans.label"))),
        "score": F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest(best, F.lit(0.0)), F.lit(0.0))),
    }
