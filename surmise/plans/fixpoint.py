"""Least fixpoints of rules over DataFrames: strata of the rule graph, semi-naive iteration inside each.

Within a recursive stratum every round joins only what the last round added: for each recursive literal of
each rule, that literal reads the last additions and the others read everything so far.  What a round adds is
written as a table of its own; a relation is the union of its tables, which are merged when they are many, and
the lineage of a round never holds the rounds before it.  A relation with several readers is stored as well.
Transitive closures are evaluated over groups of nodes that reach each other (``closure.py``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from surmise.check import check_program, infer_types
from surmise.operators.rules import derive, derive_squared, squared
from surmise.plans.closure import EDGES, closure_rules, contraction, expanded
from surmise.sources.facts import schema_of, to_frame, types_of
from surmise.sources.store import Store
from surmise.terms import INTRINSIC, Fact, Rule


#: A relation of so many tuples at least is joined with itself by lists of partners.
LARGE = 100_000
#: A relation is stored in so many tables at most; then all but the newest are merged.
MOST_TABLES = 8


def strata(rules: Sequence[Rule]) -> list[list[str]]:
    """Derived relations by strongly connected component, each after those it depends on (Tarjan)."""
    heads = list(dict.fromkeys(r.head.name for r in rules))
    needs = {h: list(dict.fromkeys(x.name for r in rules if r.head.name == h for x in r.body if x.name in heads)) for h in heads}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []
    for start in heads:
        work = [(start, iter(needs[start]))] if start not in index else []
        if work:
            index[start] = low[start] = len(index)
            stack.append(start)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    work.append((other, iter(needs[other])))
                    break
                if other in stack:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                    out.append(part[::-1])
    for part in out:
        for r in rules:
            if r.head.name in part and any(x.name in part and not x.positive for x in r.body):
                raise ValueError(f"negation through recursion: {r}")
    return out


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Fixpoint:
    """``relations`` after evaluation: given ones as they came, derived ones completed."""

    def __init__(self, spark: SparkSession, rules: Sequence[Rule], given: Mapping[str, DataFrame], types: Mapping[str, Sequence[str]]):
        self.spark, self.rules, self.types = spark, list(rules), types
        self.relations: dict[str, DataFrame] = dict(given)
        self.rounds = 0
        self.store = Store(spark)
        self.stored: set[str] = set()
        self.counts: dict[str, int] = {}

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], schema_of(self.types[name]))

    def _read(self, name: str) -> DataFrame:
        if name not in self.relations:
            self.relations[name] = self.empty(name)
        return self.relations[name]

    def run(self, wanted: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """Evaluate all derived relations, or those that ``wanted`` depends on."""
        parts = strata(self.rules)
        if wanted is not None:
            need, todo = set(), list(wanted)
            while todo:
                name = todo.pop()
                if name not in need:
                    need.add(name)
                    todo += [x.name for r in self.rules if r.head.name == name for x in r.body]
            parts = [p for p in parts if need & set(p)]
        for part in parts:
            rules = [r for r in self.rules if r.head.name in part]
            recursive = [r for r in rules if any(x.name in part for x in r.body)]
            closing = closure_rules(part[0], rules, part[0] in self.relations) if recursive and len(part) == 1 else None
            if closing and len(set(self.types[part[0]])) == 1:
                self._close(part[0], [r for r in rules if r not in recursive], closing)
            elif recursive:
                self._iterate(part, rules, recursive)
            else:
                self._once(part[0], rules)
        return self.relations

    def _base(self, name: str, rules: Sequence[Rule]) -> DataFrame:
        own = [r for r in rules if r.head.name == name]
        frames = [self._derive(r) for r in own]
        if name in self.relations:
            frames.append(self.relations[name])
        if len(frames) == 1 and own and self._by_lists(own[0]):
            return frames[0]
        return _union(frames or [self.empty(name)]).distinct()

    def _by_lists(self, rule: Rule) -> bool:
        """Whether a rule joins a large relation with itself on a column that the head drops."""
        if not squared(rule):
            return False
        source = rule.body[0].name
        if source not in self.stored:
            _, self.relations[source] = self.store.write(self._read(source), source)
            self.stored.add(source)
        if source not in self.counts:
            self.counts[source] = self.relations[source].count()
        return self.counts[source] >= LARGE

    def _derive(self, rule: Rule) -> DataFrame:
        if self._by_lists(rule):
            return derive_squared(rule, self.relations[rule.body[0].name], 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return derive(rule, lambda _, lit: self._read(lit.name))

    def _once(self, name: str, rules: Sequence[Rule]) -> None:
        self.relations[name] = self._base(name, rules)
        if sum(x.name == name for r in self.rules for x in r.body) > 1:
            # several readers: computed once
            _, self.relations[name] = self.store.write(self.relations[name], name)
            self.stored.add(name)

    def _close(self, name: str, plain: Sequence[Rule], closing: Sequence[Rule]) -> None:
        base = self._base(name, plain)
        columns = base.columns
        _, edges = self.store.write(base.toDF("x", "y"), name)
        edges, found, blocks = contraction(self.store, edges)
        if edges is not None:
            inner = Fixpoint(self.spark, closing, {EDGES: edges}, {name: self.types[name], EDGES: self.types[name]})
            inner.store, inner.stored = self.store, {EDGES}
            inner._iterate([name], closing, closing[1:])
            self.rounds += inner.rounds
            found = inner.relations[name].toDF("x", "y")
        if blocks is None:
            self.stored.add(name)
        else:
            found = expanded(self.store, found, blocks)
        self.relations[name] = found.toDF(*columns)

    def _iterate(self, part: Sequence[str], rules: Sequence[Rule], recursive: Sequence[Rule]) -> None:
        plain = [r for r in rules if r not in recursive]
        # every round reads these: computed once, not once a round
        for name in dict.fromkeys(x.name for r in recursive for x in r.body if x.name not in part and x.name not in INTRINSIC):
            if name not in self.stored:
                _, self.relations[name] = self.store.write(self._read(name), name)
                self.stored.add(name)
        paths: dict[str, list[str]] = {}
        delta: dict[str, DataFrame] = {}
        base = {name: self._base(name, plain) for name in part}
        for name, df in base.items():
            path, delta[name] = self.store.write(df, name)
            paths[name] = [path]
            self.relations[name] = delta[name]
            self.stored.add(name)
        while delta:
            self.rounds += 1
            added = {}
            for name in part:
                variants = []
                for r in (r for r in recursive if r.head.name == name):
                    for i, lit in enumerate(r.body):
                        if lit.name in delta and lit.positive and lit.name not in INTRINSIC:
                            variants.append(derive(r, lambda j, x, i=i: delta[x.name] if j == i else self._read(x.name)))
                if variants:
                    columns = self.relations[name].columns
                    # the known tuples get names of their own: both sides come from the same tables
                    known = self.relations[name].toDF(*(f"k_{c}" for c in columns))
                    new = _union(variants).distinct()
                    new = new.join(known, [new[c] == known[f"k_{c}"] for c in columns], "left_anti")
                    path, df = self.store.write(new, name)
                    if not df.isEmpty():
                        paths[name].append(path)
                        added[name] = df
            for name, df in added.items():
                if len(paths[name]) > MOST_TABLES:
                    # the tables of earlier rounds become one; the next round still reads the newest by itself
                    old = paths[name][:-1]
                    whole, _ = self.store.write(self.store.read(old, df), name)
                    paths[name] = [whole, paths[name][-1]]
                    self.store.drop(old)
                self.relations[name] = self.store.read(paths[name], df)
            delta = added


def evaluate(spark: SparkSession, rules: Sequence[Rule], given: Mapping[str, DataFrame], types: Mapping[str, Sequence[str]] | None = None, wanted: Sequence[str] | None = None, facts: Iterable[Fact] = ()) -> dict[str, DataFrame]:
    """All relations of a program without symbols, from given frames and facts; types are inferred if not given."""
    facts = list(facts)
    check_program(rules, facts)
    known = {n: types_of(df) for n, df in given.items()} | dict(types or {})
    known = infer_types(rules, facts, known)
    frames = dict(given)
    for name in dict.fromkeys(f.name for f in facts):
        own = to_frame(spark, (f for f in facts if f.name == name), known[name])
        frames[name] = frames[name].unionByName(own).distinct() if name in frames else own
    return Fixpoint(spark, rules, frames, known).run(wanted)
