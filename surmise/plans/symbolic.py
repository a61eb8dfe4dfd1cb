"""Symbolic execution: under which conditions on unknown values and unknown facts is a tuple derived?

Unknown values: each symbol gets a column in every relation that it can reach, and a domain of the constants
(and other symbols) that it can meet; rules join on these columns like on any other.  So all assignments and
all facts of interest are evaluated in one fixpoint.  A symbol assigned its own reserved value stands for
"anything": rules without negation that hold for a fresh value hold for every value.

Unknown facts: supports of the matched tuples, as sets of signed facts and used symbols, per assignment.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surmise import check
from surmise.functions import formula as fm
from surmise.operators.provenance import derivations, families, reached, tuple_key
from surmise.plans.fixpoint import Fixpoint
from surmise.sources.facts import SPARK_TYPES, fact_text, guarded, schema_of, types_of
from surmise.sources.store import Store
from surmise.terms import INTRINSIC, LOWEST, NUM, POOL, RESERVED, SYM, Fact, Literal, Number, Program, Rule, String, Symbol, Variable, substitute, symbols_of, type_of


def sentinel(index: int, kind: str) -> str | int:
    """The reserved value that stands for symbol number ``index``."""
    if kind == NUM:
        if index >= POOL - 1:
            raise ValueError(f"at most {POOL - 1} numeric symbols")
        return LOWEST + 1 + index
    return f"{RESERVED[0]}{index}"


def is_sentinel(column, kind: str):
    return column.startswith(RESERVED[0]) if kind == SYM else column < LOWEST + 1 + POOL


def locations(rules: Sequence[Rule]):
    """A function from (relation, position) to its component: places that share a variable in some rule."""
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, rule in enumerate(rules):
        for lit in (rule.head, *rule.body):
            if lit.positive and lit.name not in INTRINSIC:
                for i, a in enumerate(lit.args):
                    if isinstance(a, Variable):
                        root[find(("variable", n, a.name))] = find((lit.name, i))
    return find


@dataclass
class Domains:
    """For each symbol, the constants and symbols that it can meet in a join."""

    spark: SparkSession
    rules: Sequence[Rule]
    facts: Sequence[Fact]
    relations: Mapping[str, DataFrame]
    symbols: Sequence[Symbol]

    @cached_property
    def values(self) -> dict[str, DataFrame]:
        """symbol name -> one-column frame v0 of its domain, reserved values included."""
        find, out = locations(self.rules), {}
        place_of: dict[str, set] = {}
        constants: dict[tuple, set] = {}
        literals = [lit for r in self.rules for lit in (r.head, *r.body) if lit.name not in INTRINSIC] + [f.head for f in self.facts]
        for lit in literals:
            for i, a in enumerate(lit.args):
                if isinstance(a, Symbol):
                    place_of.setdefault(a.name, set()).add(find((lit.name, i)))
                elif isinstance(a, (String, Number)):
                    constants.setdefault(find((lit.name, i)), set()).add(a.value)
        # two symbols' places may join through a value of a third: close over symbols in several places
        merged = {s: set(p) for s, p in place_of.items()}
        changed = True
        while changed:
            changed = False
            for s in merged:
                for t in merged:
                    if merged[s] & merged[t] and not merged[t] <= merged[s]:
                        merged[s] |= merged[t]
                        changed = True
        for index, s in enumerate(self.symbols):
            places = merged.get(s.name, set())
            known = set().union(*(constants.get(p, set()) for p in places), *[[sentinel(j, o.type)] for j, o in enumerate(self.symbols) if o.name == s.name or merged.get(o.name, set()) & places])
            rows = [(v,) for v in sorted(known, key=str)]
            frames = [self.spark.createDataFrame(rows, schema_of([s.type]))]
            for name, df in self.relations.items():
                frames += [df.select(F.col(f"v{i}").alias("v0")) for i in range(len(types_of(df))) if find((name, i)) in places]
            out[s.name] = reduce(DataFrame.unionByName, frames).distinct()
        return out


@dataclass(frozen=True)
class Condition:
    """One way: symbols' equalities and the facts that must be there."""

    symbolic_assigns: tuple[fm.Eq, ...]
    dep_facts: tuple[fm.Present, ...]

    def to_formula(self):
        return fm.conjunction([*self.symbolic_assigns, *self.dep_facts])


@dataclass(frozen=True)
class OutputCondition:
    """All ways for one fact of interest."""

    sub_conditions: tuple[Condition, ...]

    @property
    def symbolic_assigns(self) -> tuple[tuple[fm.Eq, ...], ...]:
        return tuple(c.symbolic_assigns for c in self.sub_conditions)

    @property
    def dep_facts(self) -> tuple[tuple[fm.Present, ...], ...]:
        return tuple(c.dep_facts for c in self.sub_conditions)

    def to_formula(self):
        return fm.disjunction(c.to_formula() for c in self.sub_conditions)

    def __str__(self) -> str:
        return str(self.to_formula())


class SymbolicPlan:
    """The rules and input relations with a binding column for each symbol that can reach a relation.

    ``relations``: ground relations as DataFrames (v0, v1, ...); an extra boolean column ``sign`` marks the
    rows whose presence is unknown.
    """

    def __init__(self, spark: SparkSession, rules: Sequence[Rule], facts: Iterable[Fact], relations: Mapping[str, DataFrame] | None = None, known: Mapping[str, Sequence[str]] | None = None):
        self.spark, self.rules = spark, list(rules)
        self.facts = check.unique_facts(facts)
        self.relations = dict(relations or {})
        if any(not lit.positive for r in self.rules for lit in r.body):
            raise ValueError("symbolic execution needs rules without negation")
        check.check_program(self.rules, self.facts)
        check.check_reserved(a.value for f in self.facts for a in f.args if isinstance(a, (String, Number)))
        ground = {n: df.drop("sign") for n, df in self.relations.items()}
        self.types = check.infer_types(self.rules, self.facts, dict(known or {}) | {n: types_of(df) for n, df in ground.items()})
        self.symbols = symbols_of(self.facts)
        self.number = {s.name: i for i, s in enumerate(self.symbols)}
        if self.symbols:  # a reserved value in the data would pass for a symbol
            self.relations = {n: guarded(df) for n, df in self.relations.items()}
            ground = {n: df.drop("sign") for n, df in self.relations.items()}
        self.domains = Domains(spark, self.rules, self.facts, ground, self.symbols)
        self.reach = self._reach()
        self.store = Store(spark)
        self._found: dict[tuple, dict[str, DataFrame]] = {}
        self._stores = [self.store]

    @property
    def transformed(self) -> Program:
        """The program that is evaluated: rules and declarations with binding columns; its text explains a plan."""
        names = {self.binding(s.name): Variable(f"is_{s.name}") for s in self.symbols}
        return substitute(Program(self.meta_types, tuple(sorted({*self.relations, *(f.name for f in self.facts)})), rules=tuple(self.meta_rules)), names)

    def close(self) -> None:
        """Delete the tables that this plan has written: for when its results have been read."""
        for store in self._stores:
            store.clear()
        self._found = {}

    def _reach(self) -> dict[str, tuple[str, ...]]:
        """relation -> names of the symbols that can have had a part in its tuples, in order."""
        out = {n: {s.name for s in symbols_of(f for f in self.facts if f.name == n)} for n in self.types}
        changed = True
        while changed:
            changed = False
            for r in self.rules:
                more = set().union(*(out[x.name] for x in r.body if x.name not in INTRINSIC))
                if not more <= out[r.head.name]:
                    out[r.head.name] |= more
                    changed = True
        return {n: tuple(sorted(s)) for n, s in out.items()}

    def binding(self, symbol: str) -> Variable:
        return Variable(f"${self.number[symbol]}")

    def domain_name(self, symbol: str) -> str:
        return f"{RESERVED[2]}{self.number[symbol]}"

    @cached_property
    def meta_rules(self) -> list[Rule]:
        def wider(lit: Literal) -> Literal:
            if lit.name in INTRINSIC:
                return lit
            return Literal(lit.name, (*lit.args, *(self.binding(s) for s in self.reach[lit.name])))

        out = []
        for r in self.rules:
            bound = set().union(*(self.reach[x.name] for x in r.body if x.name not in INTRINSIC))
            free = [Literal(self.domain_name(s), (self.binding(s),)) for s in self.reach[r.head.name] if s not in bound]
            out.append(Rule(wider(r.head), (*map(wider, r.body), *free)))
        return out

    @cached_property
    def meta_types(self) -> dict[str, tuple[str, ...]]:
        kind = {s.name: s.type for s in self.symbols}
        return {n: (*t, *(kind[s] for s in self.reach[n])) for n, t in self.types.items()} | {self.domain_name(s.name): (s.type,) for s in self.symbols}

    @cached_property
    def inputs(self) -> dict[str, DataFrame]:
        """relation -> (v..., fid, sign, used): every input fact under every assignment of the relation's symbols."""
        out: dict[str, DataFrame] = {}
        for name, types in self.types.items():
            frames = []
            own = [f for f in self.facts if f.name == name]
            if own:
                rows = [(*(sentinel(self.number[a.name], a.type) if isinstance(a, Symbol) else a.value for a in f.args), str(f), f.symbolic_sign, [s.name for s in symbols_of([f])]) for f in own]
                ddl = ", ".join(f"v{i} {SPARK_TYPES[t].simpleString()}" for i, t in enumerate(types))
                frames.append(self.spark.createDataFrame(rows, f"{ddl}, fid string, sign boolean, used array<string>"))
            if name in self.relations:
                df = self.relations[name]
                columns = [f"v{i}" for i in range(len(types))]
                sign = F.col("sign") if "sign" in df.columns else F.lit(False)
                frames.append(df.select(*columns, fact_text(name, types, columns).alias("fid"), sign.alias("sign"), F.array().cast("array<string>").alias("used")))
            if not frames:
                continue
            df = reduce(DataFrame.unionByName, frames)
            for k, s in enumerate(self.reach[name]):
                # a relation's domain is one column of constants that this symbol can meet
                df = df.crossJoin(self.domains.values[s].toDF(f"b{k}"))
            columns = []
            for i, t in enumerate(types):
                c = F.col(f"v{i}")
                for k, s in enumerate(self.reach[name]):
                    symbol = self.symbols[self.number[s]]
                    if symbol.type == t:
                        c = F.when(F.col(f"v{i}") == sentinel(self.number[s], t), F.col(f"b{k}")).otherwise(c)
                columns.append(c.alias(f"v{i}"))
            columns += [F.col(f"b{k}").alias(f"v{len(types) + k}") for k in range(len(self.reach[name]))]
            out[name] = df.select(*columns, "fid", "sign", "used")
            if name in self.relations:
                # evaluation, derivations and leaves all read it
                _, out[name] = self.store.write(out[name], f"input-{name}")
        return out

    def evaluate(self, wanted: Sequence[str]) -> dict[str, DataFrame]:
        """All relations that ``wanted`` depends on; evaluated once, however often they are asked for."""
        key = tuple(sorted(wanted))
        if key not in self._found:
            self._found[key] = self._evaluated(key)
        return self._found[key]

    def _evaluated(self, wanted: Sequence[str]) -> dict[str, DataFrame]:
        given = {n: df.drop("fid", "sign", "used").distinct() for n, df in self.inputs.items()}
        given |= {self.domain_name(s): df for s, df in self.domains.values.items()}
        fixpoint = Fixpoint(self.spark, self.meta_rules, given, self.meta_types)
        self._stores.append(fixpoint.store)
        found = fixpoint.run(wanted)
        for n in self.types:
            found.setdefault(n, self.spark.createDataFrame([], schema_of(self.meta_types[n])))
        return found

    def matches(self, outputs: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
        """(target, v..., t...): outputs that a target (target, t...) unifies with, each symbol with one value only.

        Where no symbol reaches the relation this is an equi-join.
        """
        types = self.types[name]
        fits = F.lit(True)
        for i, t in enumerate(types):
            v, w = F.col(f"v{i}"), F.col(f"t{i}")
            open_here = any(self.symbols[self.number[s]].type == t for s in self.reach[name])
            fits = fits & ((is_sentinel(v, t) | (v == w)) if open_here else v == w)
            for j in range(i):
                if types[j] == t and open_here:
                    fits = fits & ~(is_sentinel(v, t) & (v == F.col(f"v{j}")) & (w != F.col(f"t{j}")))
        return outputs.join(wanted, fits)

    def listed(self, targets: Sequence[Fact]) -> dict[str, DataFrame]:
        """Frames of targets that a caller lists one by one; small by that, so they may be broadcast."""
        out = {}
        for name in sorted({f.name for f in targets}):
            ddl = "target string, " + ", ".join(f"t{i} {SPARK_TYPES[t].simpleString()}" for i, t in enumerate(self.types[name]))
            rows = [(str(f), *(a.value for a in f.args)) for f in targets if f.name == name]
            out[name] = F.broadcast(self.spark.createDataFrame(rows, ddl))
        return out

    def ways(self, targets: Mapping[str, DataFrame], limit: int | None = None, one: bool = False) -> DataFrame:
        """(target, bindings, matched, support): one row for every minimal support of every match, or one for each match.

        ``targets``: for each relation of interest a frame (target, t0, t1, ...); target is any text.
        """
        names = sorted(targets)
        found = self.evaluate(names)
        frames = []
        for name in names:
            columns = [F.col(f"v{i}") for i in range(len(self.meta_types[name]))]
            n = len(self.types[name])
            hit = self.matches(found[name], name, targets[name])
            key = tuple_key(name, columns)
            pairs = [F.struct(F.lit(s).alias("k"), c.cast("string").alias("v")) for s, c in zip(self.reach[name], columns[n:], strict=True)]
            bindings = F.array(*pairs).cast("array<struct<k: string, v: string>>")
            bound = [F.when(is_sentinel(columns[i], t), F.struct(columns[i].cast("string").alias("k"), F.col(f"t{i}").cast("string").alias("v"))) for i, t in enumerate(self.types[name])]
            frames.append(hit.select("target", key.alias("head"), bindings.alias("bindings"), F.array_distinct(F.array_compact(F.array(*bound))).cast("array<struct<k: string, v: string>>").alias("matched")))
        _, seeds = self.store.write(reduce(DataFrame.unionByName, frames).distinct(), "seeds")
        leaves = None
        for name, df in self.inputs.items():
            columns = [F.col(c) for c in df.columns if c not in ("fid", "sign", "used")]
            elements = F.concat(F.when(F.col("sign"), F.array(F.concat(F.lit("s:"), "fid"))).otherwise(F.array().cast("array<string>")), F.transform("used", lambda s: F.concat(F.lit("u:"), s)))
            leaf = df.select(tuple_key(name, columns).alias("head"), elements.alias("elements"))
            leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if leaves is None:
            leaves = self.spark.createDataFrame([], "head string, elements array<string>")
        need, todo = set(), set(names)
        while todo:
            need |= todo
            todo = {x.name for r in self.meta_rules if r.head.name in need for x in r.body} - need
        domain_names = {self.domain_name(s.name) for s in self.symbols}
        edges = derivations([r for r in self.meta_rules if r.head.name in need], found, domain_names)
        nodes = seeds.select("head").distinct()
        if edges is not None:
            _, edges = self.store.write(edges, "edges")
            nodes = reached(self.store, seeds, edges)
            _, edges = self.store.write(edges.join(nodes, "head", "left_semi"), "edges")
        _, leaves = self.store.write(leaves.join(nodes, "head", "left_semi"), "leaves")
        got = families(self.store, edges, leaves, one, limit).withColumnRenamed("head", "h")
        return seeds.join(got, F.col("head") == F.col("h")).select("target", "bindings", "matched", "support")

    def condition_of(self, row: Mapping) -> Condition:
        """A support in words: see the module's text on reserved values."""
        kind = {s.name: s for s in self.symbols}
        reserved = {str(sentinel(i, s.type)): s.name for i, s in enumerate(self.symbols)}
        matched = {m["k"]: m["v"] for m in row["matched"]}
        constant = lambda s, v: Number(int(v)) if kind[s].type == NUM else String(v)
        binding = {b["k"]: b["v"] for b in row["bindings"]}
        used = sorted(e[2:] for e in row["support"] if e.startswith("u:"))
        same: dict[str, list[str]] = {}
        equal: dict[str, object] = {}
        eqs: set[fm.Eq] = set()
        for s in used:
            v = binding[s]
            if v in reserved:
                same.setdefault(v, []).append(s)
            else:
                equal[s] = constant(s, v)
        for v, group in same.items():
            if v in matched:
                equal |= {s: constant(s, matched[v]) for s in group}
            else:
                eqs |= {fm.Eq(kind[group[0]], kind[s]) for s in group[1:]}
        eqs |= {fm.Eq(kind[s], v) for s, v in equal.items()}
        by_text = {str(f): f for f in self.facts}
        facts = []
        for e in sorted(row["support"]):
            if e.startswith("s:"):
                f = by_text.get(e[2:])
                shown = str(Fact(Literal(f.name, tuple(equal.get(a.name, a) if isinstance(a, Symbol) else a for a in f.args)))) if f else e[2:]
                facts.append(fm.Present(e[2:], shown))
        return Condition(tuple(sorted(eqs, key=str)), tuple(facts))


def _as_parts(rules_or_program: Program | Sequence[Rule], facts: Iterable[Fact], inline: bool) -> tuple[Sequence[Rule], list[Fact], Mapping | None]:
    if isinstance(rules_or_program, Program):
        p = rules_or_program
        return p.rules, [*facts, *(sorted(p.facts, key=str) if inline else ())], p.declarations
    return list(rules_or_program), list(facts), None


def symex(
    spark: SparkSession, rules_or_program: Program | Sequence[Rule] = (), facts: Iterable[Fact] = (), targets: Iterable[Fact] = (), relations: Mapping[str, DataFrame] | None = None,
    include_inline_facts: bool = True, limit: int | None = None, one: bool = False, plan: SymbolicPlan | None = None,
) -> dict[Fact, OutputCondition]:
    """The condition of each fact of interest; facts that can't be derived at all are absent.

    With ``one``, one way for each match instead of all.  A ``plan`` (rules, facts and relations are then its own)
    keeps what it has evaluated for further calls, until its caller closes it.
    """
    targets = check.unique_facts(targets)
    check.check_targets(targets)
    own = plan is None
    if own:
        rules, facts, known = _as_parts(rules_or_program, facts, include_inline_facts)
        plan = SymbolicPlan(spark, rules, facts, relations, known)
    for t in targets:
        if t.name not in plan.types or tuple(map(type_of, t.args)) != plan.types[t.name]:
            raise TypeError(f"{t} doesn't fit the relation {t.name}{plan.types.get(t.name, ' (unknown)')}")
    out: dict[str, set[Condition]] = {}
    for row in plan.ways(plan.listed(targets), limit, one).toLocalIterator() if targets else ():
        out.setdefault(row["target"], set()).add(plan.condition_of(row))
    if own:
        plan.close()
    return {t: OutputCondition(tuple(sorted(out[str(t)], key=lambda c: str(c.to_formula())))) for t in targets if str(t) in out}


def one_support(spark: SparkSession, rules_or_program: Program | Sequence[Rule], facts: Iterable[Fact], targets: Iterable[Fact], relations: Mapping[str, DataFrame] | None = None) -> dict[Fact, Condition]:
    """One way to derive each fact of interest that can be derived: small, though not always the smallest."""
    found = symex(spark, rules_or_program, facts, targets, relations, one=True)
    return {t: min(c.sub_conditions, key=lambda x: (len(x.dep_facts) + len(x.symbolic_assigns), str(x.to_formula()))) for t, c in found.items()}


def symex_frame(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """``symex`` as a DataFrame (target, condition), both printed."""
    rows = [(str(t), str(c)) for t, c in symex(spark, *args, **kwargs).items()]
    return spark.createDataFrame(sorted(rows), "target string, condition string")


def repair(spark: SparkSession, rules: Program | Sequence[Rule], facts: Iterable[Fact], wanted: Iterable[Fact], unwanted: Iterable[Fact] = (), relations: Mapping[str, DataFrame] | None = None, strict: bool = True) -> tuple[dict[str, object], dict[str, bool]] | None:
    """Symbol values and fact presence for which all ``wanted`` facts and no ``unwanted`` one are derived, or None.

    A wanted fact that can't be derived makes that impossible; with ``strict=False`` it is left out instead.
    """
    wanted, unwanted, facts = list(wanted), list(unwanted), list(facts)
    found = symex(spark, rules, facts, [*wanted, *(u for u in unwanted if u not in wanted)], relations)
    if strict and any(w not in found for w in wanted):
        return None
    parts = [found[w].to_formula() for w in wanted if w in found]
    parts += [fm.negation(found[u].to_formula()) for u in unwanted if u in found]
    return fm.solve(fm.conjunction(parts))
