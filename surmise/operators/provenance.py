"""Why-provenance: all minimal supports of chosen tuples, or one of each.

Derivations are a hyper-graph: an edge leads from a tuple to the tuples of one rule body that derives it, or
to an input fact.  ``reached`` walks it back from the chosen tuples (joins, one round a depth).  ``families`` then
computes the supports of every tuple on the way once, from the input facts upwards and semi-naively: each round
joins the supports that the last one found with those known, and drops what a smaller support already covers.
Tuples that share sub-proofs share that work, and no tuple's proofs have to meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surmise.operators.rules import body_frame, head_columns, variables
from surmise.sources.store import Store
from surmise.terms import INTRINSIC, Rule


def tuple_key(name: str, columns: Sequence[Column]) -> Column:
    """A text that tells tuples of all relations apart."""
    return F.concat(F.lit(name), F.to_json(F.array(*[c.cast("string") for c in columns])))


def derivations(rules: Sequence[Rule], relations: Mapping[str, DataFrame], skip: set[str]) -> DataFrame | None:
    """(head, body): one row for each way a rule derives a tuple from tuples.  ``skip``: relations that are always there."""
    out = None
    for rule in rules:
        df = body_frame(rule, lambda _, lit: relations[lit.name], variables(rule.head), tags=True)
        head = tuple_key(rule.head.name, head_columns(rule))
        body = []
        for i, lit in enumerate(rule.body):
            if lit.positive and lit.name not in INTRINSIC and lit.name not in skip:
                body.append(tuple_key(lit.name, [F.col(f"row_{i}.{c}") for c in relations[lit.name].columns]))
        edge = df.select(head.alias("head"), F.array_distinct(F.array(*body)).alias("body")).distinct()
        out = edge if out is None else out.unionByName(edge)
    return out


def reached(store: Store, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(head) of all tuples that some seed (head) is derived from, the seeds among them."""
    named = edges.select(F.col("head").alias("at"), "body")
    path, frontier = store.write(seeds.select("head").distinct(), "frontier")
    paths, like = [path], frontier
    while not frontier.isEmpty():
        steps = frontier.join(named, F.col("head") == F.col("at")).select(F.explode("body").alias("head")).distinct()
        seen = store.read(paths, like).toDF("seen")
        path, frontier = store.write(steps.join(seen, F.col("head") == F.col("seen"), "left_anti"), "frontier")
        paths.append(path)
    return store.read(paths, like)


def _as_set(elements: Column) -> Column:
    return F.array_sort(F.array_distinct(elements))


def _within(small: str, large: str) -> Column:
    return F.size(F.array_except(small, large)) == 0


def minimal(rows: DataFrame) -> DataFrame:
    """The rows (head, support) of which no other support of the same head is a part."""
    other = rows.select(F.col("head").alias("h"), F.col("support").alias("s"))
    return rows.join(other, (F.col("head") == F.col("h")) & (F.size("s") < F.size("support")) & _within("s", "support"), "left_anti")


def _steps(edges: DataFrame, size: int, new: DataFrame, known: DataFrame) -> list[DataFrame]:
    """(head, support) by every edge of ``size`` body tuples, at least one of which has a new support."""
    some, out = edges.where(F.size("body") == size).select("head", *(F.col("body")[i].alias(f"b{i}") for i in range(size))), []
    for i in range(size):
        df = some
        for j in range(size):
            source = new if j == i else known
            df = df.join(source.select(F.col("head").alias(f"h{j}"), F.col("support").alias(f"s{j}")), F.col(f"b{j}") == F.col(f"h{j}"))
        out.append(df.select("head", _as_set(F.concat(*(f"s{j}" for j in range(size)))).alias("support")))
    return out


def families(store: Store, edges: DataFrame | None, leaves: DataFrame, one: bool = False, limit: int | None = None) -> DataFrame:
    """(head, support): all minimal supports of every tuple, or with ``one`` the smallest of those found first.

    ``leaves``: (head, elements array<string>) of the input facts' tuples.  The number of minimal supports can be
    exponential; a ``limit`` makes more than so many of one tuple an error, and ``one`` has at most one row a tuple.
    """

    def chosen(rows: DataFrame) -> DataFrame:
        if not one:
            return minimal(rows.distinct())
        least = F.min(F.struct(F.size("support").alias("n"), "support")).alias("m")
        return rows.groupBy("head").agg(least).select("head", "m.support")

    found = leaves.select("head", _as_set(F.col("elements")).alias("support"))
    sizes: list[int] = []
    if edges is not None:
        sizes = sorted(r[0] for r in edges.select(F.size("body")).distinct().collect())  # body sizes: as many as the rules have
        found = found.unionByName(edges.where(F.size("body") == 0).select("head", F.array().cast("array<string>").alias("support")))
    path, new = store.write(chosen(found), "supports")
    paths, like = [path], new
    while any(sizes) and not new.isEmpty():
        known = store.read(paths, like)
        steps = reduce(DataFrame.unionByName, [s for size in sizes if size for s in _steps(edges, size, new, known)])
        seen = known.select(F.col("head").alias("h"), F.col("support").alias("s"))
        covered = (F.col("head") == F.col("h")) if one else (F.col("head") == F.col("h")) & _within("s", "support")
        path, new = store.write(chosen(steps.distinct().join(seen, covered, "left_anti")), "supports")
        paths.append(path)
        if limit is not None and (worst := store.read(paths, like).groupBy("head").count().where(F.col("count") > limit).first()):
            raise RuntimeError(f"more than {limit} minimal supports of {worst['head']}")
    return chosen(store.read(paths, like))
