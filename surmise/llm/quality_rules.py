"""Quality rules: a short-circuit cascade whose order is learned from a sample.

A rule is a condition ("reject") over named measures of the text.  On a bounded sample every rule is
timed (the least of some runs, less that of an empty job) and its rejections are counted; the rules then
run by rejections per second, best first, ties in the order given, inside one CASE expression, so a row that a rule rejects costs nothing further.  The order never changes which
rows are kept: a row is kept if no rule rejects it.

Everything is a projection: no shuffle, no Python on the executors.  Measures are expressions with
local bindings (``let``), so Spark evaluates each part once, and only where CASE reaches it.

Defined results: a null text counts as empty (all measures 0); very long texts are measured whole;
repeated rows and equal ids are judged row by row; an empty table keeps the given order and gives an
empty result; extra columns stay, and a column named like an output is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import drop_table, written

SPACE = r"[\x20\x09-\x0D]+"
SAMPLE_ROWS, REPEATS, TICK = 2_000, 3, 0.02

Measures = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Callable[[Measures], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(w: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more in ``w``.

    Windows are sorted with their positions, so that equal ones are neighbours.  Each repeated window
    covers three words, less those that the next repeated one covers too.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 3, F.size(w)), lambda third, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), third))

    def covered(marked: Column) -> Column:
        n = F.size(marked)
        left, right = F.slice(marked, 1, n - 1), F.slice(marked, 2, n - 1)

        def side(k: str) -> Column:
            return F.zip_with(left, right, lambda a, b: F.when(a["w"] == b["w"], (a if k == "a" else b)["i"]))

        at = F.sort_array(F.array_distinct(F.array_compact(F.concat(side("a"), side("b")))))
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, first, step, lambda s: s["n"])

    def counted(found: Column) -> Column:
        marked = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(marked, covered))

    return let(w, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), counted))).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    count = lambda of: F.length(F.regexp_replace(text, of, "")).cast("long")
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": count(SPACE),
        "n_symbols": count(r"[^#*$%&|<>]+"),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(words(text)),
        "n_marks": count(r"[^!]+"),
        "n_capitals": count(r"[^A-Z]+"),
        "n_letters": count(r"[^A-Za-z]+"),
    }


#: The base rules, then those of this operator's own; all compare whole numbers.
BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
OWN_RULES = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("exclamations", lambda m: 2 * m["n_marks"] > m["n_words"]),
    Rule("shouting", lambda m: 10 * m["n_capitals"] > 6 * m["n_letters"]),
    Rule("word_length", lambda m: (m["word_chars"] > 12 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
)


def sample_of(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows, by a seeded draw over the whole table."""
    total = docs.count()
    return docs.sample(fraction=min(1.0, rows / max(1, total)), seed=seed).limit(2 * rows)


def order_by_gain(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample, best first; without rejections, the cheapest first."""
    some = written(sample_of(docs.select(text), rows), "rule-sample")
    m = measures(F.col(text))
    # the last one rejects nothing: what a job costs by itself
    jobs = [(r.name, some.agg(F.count_if(r.reject(m)).alias("n"))) for r in rules] + [("", some.agg(F.count_if(F.col(text) == "").alias("n")))]
    rejected, seconds = {}, {}
    for _ in range(REPEATS):
        for name, job in jobs:
            began = time.perf_counter()
            rejected[name] = job.first()["n"]
            seconds.setdefault(name, []).append(time.perf_counter() - began)
    drop_table(docs.sparkSession, some)
    # the least of some runs is the one that least else disturbed; costs that differ by little count as equal
    cost = {name: max(1, round((min(s) - min(seconds[""])) / TICK)) for name, s in seconds.items()}
    return sorted(rules, key=lambda r: (-rejected[r.name] / cost[r.name], cost[r.name]))


def cascade(rules: Sequence[Rule], m: Measures) -> Column:
    """The name of the first rule that rejects, or null."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.reject(m), rule.name).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + OWN_RULES, text: str = "text", emit: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by`` (rule name or null), ``kept``, and the measures named in ``emit``.

    A measure that is emitted is computed for every row and then read by the rules; the others are
    computed only where the cascade gets to them.
    """
    ordered = order_by_gain(docs, rules, text, sample_rows) if sample_rows else list(rules)
    m = measures(F.col(text))
    if emit:
        # as columns of a projection of their own, whose repeated uses Spark doesn't inline
        docs = docs.withColumns({name: m[name] for name in emit})
        m |= {name: F.col(name) for name in emit}
    return docs.withColumn("rejected_by", cascade(ordered, m)).withColumn("kept", F.col("rejected_by").isNull())


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_marks > n_words
    OR 10 * n_capitals > 6 * n_letters OR word_chars > 12 * n_words OR word_chars < 2 * n_words) AS kept
FROM m"""
