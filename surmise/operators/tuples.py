"""Operations on whole relations that aren't rules: substitution, reserved values, set and multiset algebra."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surmise.terms import LOWEST, POOL, RESERVED, Symbol, Wildcard


def substitute_values(df: DataFrame, changes: Mapping[str | int, str | int]) -> DataFrame:
    """Every cell that equals a key of ``changes`` gets its value; only cells of the key's type can."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        for old, new in changes.items():
            if isinstance(old, str) == (kind == "string"):
                c = F.when(F.col(name) == F.lit(old), F.lit(new)).otherwise(c)
        out.append(c.alias(name))
    return df.select(*out)


def is_symbolic(column: Column, kind: str) -> Column:
    """Whether a cell holds a reserved value that stands for an unknown one."""
    return column.startswith(RESERVED[0]) if kind == "string" else column < LOWEST + 1 + POOL


def holds_number(column: Column) -> Column:
    """Whether a cell's text is a whole number that fits a column of numbers."""
    return column.try_cast("long").isNotNull()


def is_number(text: str) -> bool:
    """Whether a text is a whole number."""
    try:
        int(text)
    except ValueError:
        return False
    return True


def contained(part: DataFrame, whole: DataFrame) -> bool:
    """Whether every row of ``part`` is in ``whole``."""
    named = whole.toDF(*(f"w_{c}" for c in part.columns))
    return part.join(named, [part[c] == named[f"w_{c}"] for c in part.columns], "left_anti").isEmpty()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, whatever the order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def divide(whole: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``whole`` that ``part`` accounts for, the rest), as multisets."""
    return whole.intersectAll(part), whole.exceptAll(part)


def merge_by_key(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the distinct values of each key, sorted."""
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def flatten(items: Iterable) -> list:
    """Nested lists as one list; tuples and texts stay whole."""
    out: list = []
    for x in items:
        out += flatten(x) if isinstance(x, list) else [x]
    return out


def recursive_flatten(items: Iterable) -> list:
    """Lists, tuples and sets within each other as one list; texts and terms stay whole, named tuples too."""
    out: list = []
    for x in items:
        out += recursive_flatten(x) if isinstance(x, (list, tuple, set, frozenset)) and not hasattr(x, "_fields") else [x]
    return out


def is_arg_symbolic_or_wildcard(arg: object) -> bool:
    """Whether an argument leaves its value open."""
    return isinstance(arg, (Symbol, Wildcard))


def remove_duplicates(items: Iterable) -> list:
    """The first of each group of equal items, in order."""
    return list(dict.fromkeys(items))
