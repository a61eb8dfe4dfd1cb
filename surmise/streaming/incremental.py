"""Incremental evaluation: rules without negation only ever derive more, so new input tuples continue a fixpoint.

``Incremental.add`` is fit for ``writeStream.foreachBatch``: each micro-batch of one input relation becomes the
first additions of a new round, and only what follows from it is derived.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from surmise.operators.rules import derive
from surmise.plans.fixpoint import Fixpoint, _union
from surmise.terms import INTRINSIC, Rule


class Incremental:
    """A program's relations, kept complete while input tuples are added."""

    def __init__(self, spark: SparkSession, rules: Sequence[Rule], given: Mapping[str, DataFrame], types: Mapping[str, Sequence[str]]):
        if any(not lit.positive for r in rules for lit in r.body):
            raise ValueError("incremental evaluation needs rules without negation")
        self.fixpoint = Fixpoint(spark, rules, {}, types)
        self.paths: dict[str, list[str]] = {}
        for name in types:
            self._append(name, given[name] if name in given else self.fixpoint.empty(name))
        for name, df in list(self.fixpoint.relations.items()):
            self._continue({name: df})

    @property
    def relations(self) -> dict[str, DataFrame]:
        return self.fixpoint.relations

    def _append(self, name: str, df: DataFrame) -> DataFrame | None:
        """Write the tuples of ``df`` that ``name`` doesn't hold yet; None if there are none."""
        new = df.distinct()
        if name in self.paths:
            known = self.relations[name].toDF(*(f"k_{c}" for c in df.columns))
            new = new.join(known, [new[c] == known[f"k_{c}"] for c in df.columns], "left_anti")
        path, added = self.fixpoint.store.write(new, name)
        if name in self.paths and added.isEmpty():
            return None
        self.paths.setdefault(name, []).append(path)
        self.relations[name] = self.fixpoint.store.read(self.paths[name], added)
        return added

    def _continue(self, delta: dict[str, DataFrame]) -> None:
        while delta:
            found: dict[str, list[DataFrame]] = {}
            for r in self.fixpoint.rules:
                for i, lit in enumerate(r.body):
                    if lit.name in delta and lit.name not in INTRINSIC:
                        found.setdefault(r.head.name, []).append(derive(r, lambda j, x, i=i: delta[x.name] if j == i else self.relations[x.name]))
            new = {name: self._append(name, _union(frames)) for name, frames in found.items()}
            delta = {name: df for name, df in new.items() if df is not None}

    def add(self, name: str, rows: DataFrame) -> None:
        """Take new tuples of an input relation in and derive all that follows."""
        added = self._append(name, rows.toDF(*(f"v{i}" for i in range(len(rows.columns)))))
        if added is not None:
            self._continue({name: added})

    def writer(self, name: str):
        """A function for ``foreachBatch`` that adds each micro-batch to ``name``."""
        return lambda batch, _: self.add(name, batch)
