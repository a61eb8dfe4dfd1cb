"""The language: terms, literals, rules, facts and programs.

All nodes are immutable and compare by type and value, so a variable never equals a string of its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

SYM, NUM = "symbol", "number"
#: Names that facts and data may not begin with: the engine makes columns and values of these kinds itself.
RESERVED = ("surmise_symbolic_", "surmise_binding_", "surmise_domain_")
#: Numbers from the lowest one on that stand for unknown values, and so may not be in data.
LOWEST, POOL = -(2**63), 1000
#: Predicates that are computed, not stored.
INTRINSIC = {"contains"}


@dataclass(frozen=True)
class Variable:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Wildcard:
    def __str__(self) -> str:
        return "_"


@dataclass(frozen=True)
class String:
    value: str

    def __str__(self) -> str:
        return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"'


@dataclass(frozen=True)
class Number:
    value: int

    def __str__(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Symbol:
    """An unknown value of a known type."""

    name: str
    type: str = SYM

    def __str__(self) -> str:
        return self.name


Term = Variable | Wildcard | String | Number | Symbol


@dataclass(frozen=True, init=False)
class Literal:
    name: str
    args: tuple[Term, ...]
    positive: bool

    def __init__(self, name: str, args: Iterable[Term] = (), positive: bool = True, *, sign: bool | None = None):
        """``sign`` is another name of ``positive``."""
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "args", tuple(args))
        object.__setattr__(self, "positive", positive if sign is None else sign)

    def __str__(self) -> str:
        return f"{'' if self.positive else '!'}{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Rule:
    head: Literal
    body: tuple[Literal, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "body", tuple(self.body))

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class Fact:
    """A tuple of a relation; with ``symbolic_sign``, one that may or may not be there.

    Built from a literal, or as ``Fact(name, args)``.
    """

    head: Literal
    symbolic_sign: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.head, str):
            object.__setattr__(self, "head", Literal(self.head, () if isinstance(self.symbolic_sign, bool) else self.symbolic_sign))
            object.__setattr__(self, "symbolic_sign", False)

    @property
    def name(self) -> str:
        return self.head.name

    @property
    def args(self) -> tuple[Term, ...]:
        return self.head.args

    def __str__(self) -> str:
        return f"{self.head}."


@dataclass(frozen=True)
class Program:
    declarations: Mapping[str, tuple[str, ...]]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    facts: frozenset[Fact] = field(default_factory=frozenset)
    symbols: tuple[Symbol, ...] = ()

    def __str__(self) -> str:
        lines = [f".decl {name}({', '.join(f'v{i}: {t}' for i, t in enumerate(types))})" for name, types in self.declarations.items()]
        lines += [f".input {name}" for name in self.inputs] + [f".output {name}" for name in self.outputs]
        return "\n".join(lines + [str(r) for r in self.rules] + sorted(map(str, self.facts)))


def render(node: Any) -> str:
    """The program text of any node."""
    return str(node)


def _parts(node: Any) -> Iterator[Any]:
    if isinstance(node, Mapping):
        yield from node.values()
    elif isinstance(node, (tuple, list, frozenset, set)):
        yield from node
    elif is_dataclass(node):
        for f in fields(node):
            yield getattr(node, f.name)


def walk(visit: Callable[[Any], None], node: Any) -> None:
    """Call ``visit`` on every node, parents first."""
    if is_dataclass(node):
        visit(node)
    for part in _parts(node):
        walk(visit, part)


def collect(keep: Callable[[Any], bool], node: Any) -> list[Any]:
    """All nodes that ``keep`` accepts, in the order of a walk."""
    found: list[Any] = []
    walk(lambda n: found.append(n) if keep(n) else None, node)
    return found


def transform(change: Callable[[Any], Any], node: Any) -> Any:
    """Rebuild ``node`` from below; ``change`` maps each rebuilt node to its replacement.

    Facts that turn into rules (and rules that turn into facts) move to the matching part of their program.
    """
    if isinstance(node, Program):
        parts = [transform(change, x) for x in (*node.rules, *sorted(node.facts, key=str))]
        rules, facts = tuple(p for p in parts if isinstance(p, Rule)), frozenset(p for p in parts if isinstance(p, Fact))
        return change(replace(node, rules=rules, facts=facts, symbols=tuple(transform(change, s) for s in node.symbols)))
    if isinstance(node, (tuple, list, frozenset, set)):
        return type(node)(transform(change, x) for x in node)
    if isinstance(node, Mapping):
        return {k: transform(change, v) for k, v in node.items()}
    if is_dataclass(node):
        new = {f.name: transform(change, getattr(node, f.name)) for f in fields(node)}
        return change(type(node)(**new))
    return node


def substitute(source: Any, changes: Mapping[Term, Term]) -> Any:
    """``source`` with each term replaced that ``changes`` names; types count."""
    return transform(lambda n: changes.get(n, n) if isinstance(n, Term) else n, source)


def symbols_of(facts: Iterable[Fact]) -> tuple[Symbol, ...]:
    """The distinct symbols of facts, by name."""
    return tuple(sorted({a for f in facts for a in f.args if isinstance(a, Symbol)}, key=lambda s: (s.name, s.type)))


def type_of(term: Term) -> str | None:
    if isinstance(term, Symbol):
        return term.type
    return {String: SYM, Number: NUM}.get(type(term))
