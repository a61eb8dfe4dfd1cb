"""The public names: builders, parsing, loading, symbolic execution, repair."""

from __future__ import annotations

from itertools import count

from surmise.check import make_program
from surmise.functions.delta import all_minimal, ddmin, ddmin_all
from surmise.parser import parse, parse_text
from surmise.plans.files import run_program
from surmise.plans.fixpoint import evaluate
from surmise.plans.symbolic import SymbolicPlan, one_support, repair, symex, symex_frame
from surmise.sources.facts import load_facts, load_relations, relation, to_frame, write_facts, write_relations
from surmise.terms import NUM, SYM, Fact, Literal, Number, Program, Rule, String, Symbol, substitute
from surmise.terms import Variable as _Variable
from surmise.terms import Wildcard as _Wildcard


def Variable(name: str):  # noqa: N802
    """A variable; ``_`` is a wildcard."""
    return _Wildcard() if name == "_" else _Variable(name)


_numbers = count(1)
#: A checked program with inferred declarations.
infer_whole_program = make_program


def SymbolicConstant(name: str | None = None, type: str = SYM) -> Symbol:  # noqa: N802
    """An unknown value; without a name it gets one that no other has had."""
    name = f"unknown_{next(_numbers)}" if name is None else name
    if type not in (SYM, NUM):
        raise ValueError(f"unknown symbol type {type!r}")
    return Symbol(name, type)


def SymbolicSign(fact: Fact) -> Fact:  # noqa: N802
    """The fact, of which it is unknown whether it is there."""
    return Fact(fact.head, True)


def make_fact(name: str, args) -> Fact:
    return Fact(Literal(name, tuple(args)))


__all__ = ["NUM", "SYM", "Fact", "Literal", "Number", "Program", "Rule", "String", "SymbolicConstant", "SymbolicPlan", "SymbolicSign", "Variable", "all_minimal", "ddmin", "ddmin_all", "evaluate", "infer_whole_program", "load_facts", "load_relations", "make_fact", "make_program", "one_support", "parse", "parse_text", "relation", "repair", "run_program", "substitute", "symex", "symex_frame", "to_frame", "write_facts", "write_relations"]
