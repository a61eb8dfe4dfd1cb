"""Parser, builders, checks, type inference."""

import pytest

from surmise import check
from surmise.api import Fact, Literal, Number, Rule, String, SymbolicConstant, SymbolicSign, Variable, make_fact, parse, parse_text, substitute
from surmise.terms import Symbol, Wildcard, collect, transform, walk

X, Y, Z = Variable("x"), Variable("y"), Variable("z")


def lit(name, *args):
    return Literal(name, args)


def test_declarations_inputs_outputs():
    p = parse_text(".decl my_relation(x: number, y: string)\n.input my_input\n.output my_output // done\n")
    assert p.declarations == {"my_relation": ("number", "string")}
    assert (p.inputs, p.outputs) == (("my_input",), ("my_output",))


@pytest.mark.parametrize("text", ["path(x, y) :- edge(x, y).", 'p(x, "a") :- q(x, _, -3), contains("b", x).', "path(x, z) :- path(x, y), edge(y, z)."])
def test_rules_print_as_they_are_written(text):
    assert str(parse_text(text).rules[0]) == text


def test_facts_and_escapes_round_trip():
    (fact,) = parse_text('edge("a\\"b\\\\", 1).').facts
    assert fact.args == (String('a"b\\'), Number(1))
    assert str(fact) == 'edge("a\\"b\\\\", 1).'


def test_whole_program_round_trip():
    text = '.decl edge(v0: symbol, v1: symbol)\n.input edge\n.output path\npath(x, y) :- edge(x, y).\nedge("a", "b").'
    p = parse_text(text)
    assert str(p) == text and parse_text(str(p)) == p


@pytest.mark.parametrize("text", ["p(x) :- q(x), x < y.", "p(x) :- q(x)", "p().", "p(1.5).", ".unknown p", "p(x) :- ."])
def test_parse_errors(text):
    with pytest.raises(ValueError):
        parse_text(text)


@pytest.mark.parametrize("text", ["p(x) :- q(x), !r(x).", '#include "x"'])
def test_unsupported_text(text):
    with pytest.raises(NotImplementedError):
        parse_text(text)


def test_parse_file(tmp_path):
    (tmp_path / "p.dl").write_text("p(x) :- q(x).")
    assert len(parse(tmp_path / "p.dl").rules) == 1
    with pytest.raises(ValueError):
        parse(tmp_path / "absent.dl")


def test_builders():
    assert Variable("_") == Wildcard() and Variable("x") != String("x")
    assert SymbolicConstant("alpha") == Symbol("alpha", "symbol")
    with pytest.raises(ValueError):
        SymbolicConstant("a", "unknown_type")
    f = make_fact("p", [String("a")])
    assert SymbolicSign(f).symbolic_sign and not f.symbolic_sign


def test_visitors_and_substitution():
    alpha = SymbolicConstant("alpha")
    fact = make_fact("p", [String("a"), Number(1)])
    assert substitute(fact, {String("a"): alpha}).args == (alpha, Number(1))
    assert substitute(fact, {Number(1): Number(2)}).args == (String("a"), Number(2))
    assert collect(lambda n: isinstance(n, Number), fact) == [Number(1)]
    seen = []
    walk(seen.append, fact)
    assert seen[0] == fact
    p = parse_text('p(x) :- q(x). q("a").')
    moved = transform(lambda n: Rule(n.head, (lit("r", String("b")),)) if isinstance(n, Fact) else n, p)
    assert len(moved.rules) == 2 and not moved.facts


GOOD = Rule(lit("p", X, Y), (lit("q", X, Y),))


@pytest.mark.parametrize(
    ("rules", "facts"),
    [
        ([GOOD, Rule(lit("p", X), (lit("q", X, Y),))], []),
        ([Rule(lit("p", X), (lit("q", X, String("a")), lit("q", X, Number(1))))], []),
        ([Rule(lit("p", Variable("_")), (lit("q", X),))], []),
        ([Rule(lit("p", Z), (lit("q", X),))], []),
        ([Rule(Literal("p", (X,), False), (lit("q", X),))], []),
        ([Rule(lit("p", String("a")), ())], []),
        ([Rule(lit("p", SymbolicConstant("a")), (lit("q", X),))], []),
        ([], [Fact(lit("p", X))]),
        ([], [Fact(lit("p", String(3)))]),
        ([], [make_fact("p", [String("a")]), make_fact("p", [SymbolicConstant("a", "number")])]),
    ],
)
def test_type_errors(rules, facts):
    with pytest.raises(TypeError):
        check.check_program(rules, facts)


def test_symbol_names_are_unique():
    with pytest.raises(ValueError, match="already used"):
        check.check_program([], [make_fact("p", [SymbolicConstant("a")]), make_fact("q", [SymbolicConstant("a", "number")])])


def test_good_programs_pass():
    check.check_program([GOOD], [make_fact("q", [String("a"), Number(1)])])


def test_inference():
    facts = [make_fact("foo", [String("a"), Number(1)]), make_fact("bar", [String("b"), Number(2)])]
    rules = [Rule(lit("baz", X, Y), (lit("foo", X, Y),)), Rule(lit("qux", X, Y), (lit("bar", X, Z), lit("baz", X, Y)))]
    assert check.infer_types(rules, facts) == dict.fromkeys(["foo", "bar", "baz", "qux"], ("symbol", "number"))


@pytest.mark.parametrize("rules", [[Rule(lit("p", X), (lit("foo", X, Y), lit("foo", Y, X)))], [Rule(lit("p", X), (lit("nothing_known", X),))]])
def test_inference_errors(rules):
    with pytest.raises(TypeError):
        check.infer_types(rules, [make_fact("foo", [String("a"), Number(1)])])


def test_targets_and_reserved_values():
    with pytest.raises(ValueError):
        check.check_targets([make_fact("p", [SymbolicConstant("a")])])
    with pytest.raises(ValueError):
        check.check_reserved(["surmise_symbolic_1"])
    with pytest.warns(UserWarning):
        assert len(check.unique_facts([GOOD, GOOD])) == 1
