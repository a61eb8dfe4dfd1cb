"""One rule as a DataFrame plan: scans, filters, equi-joins, semi-joins, anti-joins, projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surmise.terms import INTRINSIC, Literal, Number, Rule, String, Term, Variable, Wildcard


def var(name: str) -> str:
    return f"x_{name}"


def value(term: Term) -> Column:
    if isinstance(term, String):
        return F.lit(term.value)
    if isinstance(term, Number):
        return F.lit(term.value).cast("long")
    return F.col(var(term.name))


def variables(lit: Literal) -> set[str]:
    return {a.name for a in lit.args if isinstance(a, Variable)}


def scan(df: DataFrame, lit: Literal, tag: str | None = None) -> DataFrame:
    """The rows of a relation that fit a literal, as columns of its variables; ``tag`` keeps the whole row too.

    Columns are renamed right here, so joins never meet the same attribute twice.
    """
    columns = df.columns
    first: dict[str, str] = {}
    for c, a in zip(columns, lit.args, strict=True):
        if isinstance(a, Variable):
            if a.name in first:
                df = df.where(F.col(c) == F.col(first[a.name]))
            else:
                first[a.name] = c
        elif not isinstance(a, Wildcard):
            df = df.where(F.col(c) == value(a))
    out = [F.col(c).alias(var(name)) for name, c in first.items()]
    if tag:
        out.append(F.struct(*columns).alias(tag))
    return df.select(*out)


def intrinsic(lit: Literal) -> Column:
    """``contains(needle, hay)``."""
    needle, hay = (value(a) for a in lit.args)
    out = F.contains(hay, needle)
    return out if lit.positive else ~out


def ordered(body: Sequence[Literal]) -> list[int]:
    """Body positions so that each literal shares a variable with an earlier one where that is possible."""
    left = [i for i, lit in enumerate(body) if lit.positive and lit.name not in INTRINSIC]
    bound: set[str] = set()
    out = []
    while left:
        best = next((i for i in left if not out or variables(body[i]) & bound), left[0])
        left.remove(best)
        out.append(best)
        bound |= variables(body[best])
    return out


def body_frame(rule: Rule, source: Callable[[int, Literal], DataFrame], needed: set[str], tags: bool = False) -> DataFrame:
    """The body's join with the variables in ``needed``; with ``tags`` also each literal's row as ``row_<i>``.

    A literal none of whose new variables is used later becomes a semi-join.  A literal without a shared
    variable is a cross product: that is what such a rule asks for.
    """
    order = ordered(rule.body)
    filters = [lit for lit in rule.body if lit.name in INTRINSIC]
    negated = [lit for lit in rule.body if not lit.positive and lit.name not in INTRINSIC]
    late = set().union(needed, *(variables(x) for x in (*filters, *negated)))
    out: DataFrame | None = None
    for k, i in enumerate(order):
        lit = rule.body[i]
        df = scan(source(i, lit), lit, f"row_{i}" if tags else None)
        later = late.union(*(variables(rule.body[j]) for j in order[k + 1 :]))
        if out is None:
            out = df
        else:
            shared = [c for c in out.columns if c in df.columns]
            extra = {c for c in df.columns if c not in shared}
            if not shared:
                out = out.crossJoin(df)
            elif not tags and not extra & {var(v) for v in later}:
                out = out.join(df.select(*shared), shared, "left_semi")
            else:
                out = out.join(df, shared, "inner")
        for f in [f for f in filters if {var(v) for v in variables(f)} <= set(out.columns)]:
            out = out.where(intrinsic(f))
            filters.remove(f)
        if not tags:
            still = later.union(*(variables(f) for f in filters))
            keep = [c for c in out.columns if c in {var(v) for v in still}]
            # a body whose variables all go still says whether it holds
            out = out.select(*keep) if keep else out.select(F.lit(1).alias("holds")).limit(1) if k == len(order) - 1 else out
    if out is None:
        raise TypeError(f"no stored relation in the body of {rule}")
    for lit in negated:
        df = scan(source(-1, lit), lit)
        shared = [c for c in out.columns if c in df.columns]
        if shared:
            out = out.join(df, shared, "left_anti")
        else:
            out = out.crossJoin(df.agg(F.count("*").alias("n_found"))).where("n_found = 0").drop("n_found")
    return out


def head_columns(rule: Rule) -> list[Column]:
    return [value(a).alias(f"v{i}") for i, a in enumerate(rule.head.args)]


def derive(rule: Rule, source: Callable[[int, Literal], DataFrame]) -> DataFrame:
    """The head tuples of one rule, not yet distinct."""
    return body_frame(rule, source, variables(rule.head)).select(*head_columns(rule))


#: Of the partners that a key has in a squared join, so many stand in one row at most.
MOST_PARTNERS = 4096


def squared(rule: Rule) -> tuple[str, str, str] | None:
    """(a, b, p) of a rule q(.. a .. b ..) :- e(a, p), e(b, p), whatever the order of arguments; p isn't in the head."""
    if len(rule.body) != 2 or len({x.name for x in rule.body}) != 1 or any(not x.positive or x.name in INTRINSIC for x in rule.body):
        return None
    first, second = (variables(x) for x in rule.body)
    own = [first - second, second - first, first & second]
    if any(len(x) != 1 for x in own) or any(len(x.args) != 2 for x in rule.body) or variables(rule.head) != own[0] | own[1]:
        return None
    return tuple(x.pop() for x in own)


def derive_squared(rule: Rule, df: DataFrame, tasks: int) -> DataFrame:
    """The distinct head tuples of a ``squared`` rule: each range of a, of ``tasks``, gets the partner lists of its keys once.

    The pairs themselves are never shuffled; those of one range meet in one task.
    """
    a, b, p = (var(x) for x in squared(rule))
    # dealt by key once, for the lists and for their join
    left, right = (scan(df, lit).repartition(p) for lit in rule.body)
    if left.schema[a].dataType.simpleString() == "bigint":
        low, high = scan(df, rule.body[0]).agg(F.min(a), F.max(a)).head()
        span = (high or 0) - (low or 0) + 1
        part = F.least(F.lit(tasks - 1), F.floor((F.col(a) - (low or 0)).cast("double") / span * tasks)).cast("long")
    else:
        part = F.pmod(F.xxhash64(a), F.lit(tasks))
    mine = left.groupBy(p, part.alias("part")).agg(F.collect_list(a).alias("mine"))
    block = F.floor((F.row_number().over(Window.partitionBy(p).orderBy(b)) - 1) / MOST_PARTNERS)
    theirs = right.select(p, b, block.alias("block")).groupBy(p, "block").agg(F.collect_list(b).alias("theirs"))
    lists = mine.join(theirs, p).select("part", "mine", "theirs").repartition(tasks, "part")
    pairs = lists.select("part", F.explode("mine").alias(a), "theirs").select("part", a, F.explode("theirs").alias(b))
    return pairs.groupBy("part", a, b).agg(F.lit(1).alias("one")).select(*head_columns(rule))
