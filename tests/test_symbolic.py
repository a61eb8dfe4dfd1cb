"""Symbolic execution: golden conditions, and a brute-force comparison over random programs."""

import random
from itertools import product

import pytest

from surmise.api import Fact, Literal, Number, Rule, String, SymbolicConstant, SymbolicSign, Variable, evaluate, make_fact, one_support, parse_text, repair, symex, to_frame
from surmise.functions import formula as fm
from surmise.plans.symbolic import SymbolicPlan
from surmise.terms import Symbol

ALPHA = SymbolicConstant("alpha")
JOIN = parse_text("t(x, z) :- r(x, y), s(y, z).").rules
REACH = parse_text("reachable(x, y) :- edge(x, y). reachable(x, z) :- edge(x, y), reachable(y, z).").rules


def f(name, *args):
    return make_fact(name, [String(a) if isinstance(a, str) else Number(a) if isinstance(a, int) else a for a in args])


def eq(value, symbol=ALPHA):
    return fm.Eq(symbol, String(value))


R, S = [f("r", "b", "c"), f("s", "b", "c")], f("s", "c", "d")


@pytest.mark.parametrize(
    ("rules", "facts", "target", "expected"),
    [
        (JOIN, [SymbolicSign(f("r", "a", "b")), *R, SymbolicSign(S)], f("t", "a", "c"), fm.Present('r("a", "b").')),
        (JOIN, [f("r", ALPHA, "b"), *R, SymbolicSign(S)], f("t", "b", "d"), fm.Present('s("c", "d").')),
        (JOIN, [SymbolicSign(f("r", ALPHA, "b")), *R, SymbolicSign(S)], f("t", "a", "c"), fm.conjunction([eq("a"), fm.Present('r(alpha, "b").')])),
        (JOIN, [f("r", ALPHA, "b"), *R, SymbolicSign(S)], f("t", "e", "c"), eq("e")),
        (JOIN, [f("r", "a", "b"), *R, S], f("t", "a", "c"), fm.TRUE),
        (JOIN, [f("r", "a", "b"), *R, S], f("t", "e", "c"), None),
        (JOIN, [f("r", ALPHA, 1), f("r", "1", 3), f("s", 1, 2), f("s", 2, 3)], f("t", "1", 2), eq("1")),
        (REACH, [SymbolicSign(f("edge", ALPHA, "b")), SymbolicSign(f("edge", "b", "c")), f("edge", "c", "b"), f("edge", "c", "d")], f("reachable", "a", "b"), fm.conjunction([eq("a"), fm.Present('edge(alpha, "b").')])),
        (REACH, [f("edge", "c", ALPHA), f("edge", ALPHA, "b")], f("reachable", "c", "b"), fm.TRUE),
        (REACH, [f("edge", ALPHA, "e"), f("edge", "b", "d")], f("reachable", "b", "e"), fm.disjunction([eq("b"), eq("d")])),
        (REACH, [SymbolicSign(f("edge", "a", ALPHA))], f("edge", "a", "b"), fm.conjunction([eq("b"), fm.Present('edge("a", alpha).')])),
    ],
)
def test_golden_conditions(spark, rules, facts, target, expected):
    found = symex(spark, rules, facts, [target])
    if expected is None:
        assert target not in found
    else:
        assert fm.equivalent(found[target].to_formula(), expected), str(found[target])


def test_shown_facts_have_their_values(spark):
    found = symex(spark, JOIN, [SymbolicSign(f("r", ALPHA, "b")), *R], [f("t", "a", "c")])
    assert str(found[f("t", "a", "c")]) == 'And(alpha == "a", r("a", "b").)'
    (sub,) = found[f("t", "a", "c")].sub_conditions
    assert sub.symbolic_assigns == (eq("a"),) and [str(p) for p in sub.dep_facts] == ['r("a", "b").']


def test_numbers_can_be_unknown(spark):
    n = SymbolicConstant("n", "number")
    found = symex(spark, JOIN, [f("r", "a", n), f("s", 7, "z")], [f("t", "a", "z")])
    assert found[f("t", "a", "z")].to_formula() == fm.Eq(n, Number(7))


def test_relations_from_frames(spark):
    s = to_frame(spark, [f("s", "b", "c")], ["symbol", "symbol"])
    found = symex(spark, JOIN, [f("r", "a", ALPHA)], [f("t", "a", "c")], {"s": s})
    assert found[f("t", "a", "c")].to_formula() == eq("b")


def test_negation_is_refused(spark):
    rule = Rule(Literal("p", (Variable("x"),)), (Literal("q", (Variable("x"),)), Literal("r", (Variable("x"),), False)))
    with pytest.raises(ValueError):
        SymbolicPlan(spark, [rule], [])


def test_wrong_targets(spark):
    with pytest.raises(TypeError):
        symex(spark, JOIN, [f("r", "a", "b"), f("s", "b", "c")], [f("t", "a", 1)])
    assert symex(spark, JOIN, R, []) == {}


def test_repair(spark):
    facts = [f("r", ALPHA, "b"), SymbolicSign(f("s", "b", "c")), f("s", "b", "d")]
    values, there = repair(spark, JOIN, facts, [f("t", "a", "d")], [f("t", "a", "c")])
    assert values == {"alpha": "a"} and there == {'s("b", "c").': False}
    assert repair(spark, JOIN, facts, [f("t", "a", "nowhere")]) is None
    assert repair(spark, JOIN, facts, [f("t", "a", "nowhere")], strict=False) is not None
    assert repair(spark, JOIN, facts, [f("t", "a", "d")], [f("t", "a", "d")]) is None


def _naive(rules, facts):
    """Least fixpoint of ground facts, by trying everything."""
    known = {(x.name, tuple(a.value for a in x.args)) for x in facts}
    while True:
        new = set()
        for r in rules:
            envs = [{}]
            for lit in r.body:
                nxt = []
                for env in envs:
                    for name, row in known:
                        if name == lit.name:
                            e, ok = dict(env), True
                            for a, v in zip(lit.args, row, strict=True):
                                if isinstance(a, String):
                                    ok &= a.value == v
                                else:
                                    ok &= e.setdefault(a.name, v) == v
                            if ok:
                                nxt.append(e)
                envs = nxt
            new |= {(r.head.name, tuple(a.value if isinstance(a, String) else e[a.name] for a in r.head.args)) for e in envs}
        if new <= known:
            return known
        known |= new


PROGRAMS = [
    "p(x, z) :- e(x, y), e(y, z).",
    "p(x, y) :- e(x, y). p(x, z) :- p(x, y), p(y, z).",
    'p(x, x) :- e(x, y), g(y, "a"). p(x, y) :- g(x, y), e(y, x).',
]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    """Every valuation of symbols and signs gives the truth that evaluating that input gives."""
    rng = random.Random(seed)
    names, beta = "abc", SymbolicConstant("beta")
    rules = parse_text(PROGRAMS[seed]).rules
    facts = []
    for name in "eg":
        for _ in range(3):
            args = [rng.choice([*names, *names, ALPHA, beta]) for _ in range(2)]
            fact = f(name, *args)
            facts.append(SymbolicSign(fact) if rng.random() < 0.4 else fact)
    facts = list({str(x): x for x in facts}.values())
    targets = [f("p", a, b) for a, b in product("abz", "ac")]
    found = symex(spark, rules, facts, targets)
    symbols = sorted({a.name for x in facts for a in x.args if isinstance(a, Symbol)})
    signed = [x for x in facts if x.symbolic_sign]
    for combo in product([*names, "fresh"], repeat=len(symbols)):
        values = dict(zip(symbols, combo, strict=True))
        for bits in product((False, True), repeat=len(signed)):
            gone = {str(x) for x, b in zip(signed, bits, strict=True) if not b}
            ground = [make_fact(x.name, [String(values[a.name]) if isinstance(a, Symbol) else a for a in x.args]) for x in facts if str(x) not in gone]
            truth = _naive(rules, ground)
            there = {str(x) for x in facts} - gone
            for t in targets:
                said = t in found and fm.holds(found[t].to_formula(), values, there)
                assert said == ((t.name, tuple(a.value for a in t.args)) in truth), (str(t), values, gone, str(found.get(t)))


def test_evaluation_of_all_rule_forms(spark):
    facts = parse_text('e("a", "b"). e("b", "c"). e("c", "c"). n("a", 1). n("b", 2). w("xay").').facts
    text = 'same(x) :- e(x, x). k("k", x, x) :- e(x, _). c(x) :- e(x, "c"). pair(x, y) :- n(x, _), n(y, _). has(w) :- w(w), contains("a", w). any("yes") :- e(_, _). num(y) :- n("b", y).'
    found = evaluate(spark, parse_text(text).rules, {}, None, None, facts)
    rows = lambda n: {tuple(r) for r in found[n].collect()}
    assert rows("same") == {("c",)} and rows("c") == {("b",), ("c",)} and rows("num") == {(2,)}
    assert rows("k") == {("k", x, x) for x in "abc"} and rows("pair") == set(product("ab", "ab"))
    assert rows("has") == {("xay",)} and rows("any") == {("yes",)}


def test_stratified_negation(spark):
    x = Variable("x")
    rules = [Rule(Literal("p", (x,)), (Literal("q", (x,)), Literal("r", (x,), False)))]
    found = evaluate(spark, rules, {}, None, None, [f("q", "a"), f("q", "b"), f("r", "a")])
    assert [tuple(r) for r in found["p"].collect()] == [("b",)]
    with pytest.raises(ValueError, match="recursion"):
        evaluate(spark, [Rule(Literal("p", (x,)), (Literal("q", (x,)), Literal("p", (x,), False)))], {}, None, None, [f("q", "a")])


def test_formulas():
    p, q = fm.Present("p."), fm.Present("q.")
    assert fm.disjunction([p, fm.conjunction([p, q])]) == p
    assert fm.conjunction([]) == fm.TRUE and fm.disjunction([]) == fm.FALSE and fm.negation(fm.negation(p)) == p
    assert not fm.equivalent(p, q) and fm.solve(fm.conjunction([p, fm.negation(p)])) is None
    assert fm.equivalent(fm.Eq(ALPHA, Symbol("beta")), fm.Eq(Symbol("beta"), ALPHA))


def test_reserved_values_in_frames_fail(spark):
    """A cell that looks like a symbol must not be taken for one: numbers and texts, in frames and facts."""
    rules = parse_text("t(x, z) :- r(x, y), s(y, z).").rules
    for bad, beta in ((["surmise_symbolic_0"], ALPHA), ([-(2**63) + 1], SymbolicConstant("n", "number"))):
        frame = spark.createDataFrame([(bad[0], "c")], f"v0 {'string' if beta is ALPHA else 'long'}, v1 string")
        with pytest.raises(Exception, match="reserved"):
            symex(spark, rules, [f("r", "a", beta)], [f("t", "a", "c")], {"s": frame})
    with pytest.raises(ValueError, match="reserved"):
        symex(spark, rules, [f("r", "a", -(2**63) + 2), f("s", -(2**63) + 2, "c")], [f("t", "a", "c")])


def test_plans_are_evaluated_once_and_explained(spark):
    plan = SymbolicPlan(spark, JOIN, [f("r", ALPHA, "b"), *R, SymbolicSign(S)])
    first = symex(spark, targets=[f("t", "a", "c")], plan=plan)
    held = plan.evaluate(["t"])
    second = symex(spark, targets=[f("t", "e", "c")], plan=plan)
    assert plan.evaluate(["t"]) is held
    assert (str(first[f("t", "a", "c")]), str(second[f("t", "e", "c")])) == ('alpha == "a"', 'alpha == "e"')
    text = str(plan.transformed)
    assert "t(x, z, is_alpha) :- r(x, y, is_alpha), s(y, z)." in text and parse_text(text).rules
    plan.close()


def test_one_support(spark):
    facts = [SymbolicSign(f("edge", a, b)) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "d"), ("x", "a"), ("d", "a"))]
    targets = [f("reachable", "a", "d"), f("reachable", "a", "c"), f("reachable", "d", "x")]
    one = one_support(spark, REACH, facts, targets)
    assert set(one) == set(targets[:2]) and [str(p) for p in one[targets[1]].dep_facts] == ['edge("a", "c").']
    every = symex(spark, REACH, facts, targets[:2])
    assert all({p.fact for p in one[t].dep_facts} in [{p.fact for p in c.dep_facts} for c in every[t].sub_conditions] for t in targets[:2])
    assert len(every[targets[0]].sub_conditions) == 3
    with pytest.raises(RuntimeError, match="more than 1"):
        symex(spark, REACH, facts, targets[:1], limit=1)


def test_builders_take_names():
    assert Fact("r", [String("a"), ALPHA]) == make_fact("r", [String("a"), ALPHA])
    assert Literal("r", [String("a")], sign=False) == Literal("r", (String("a"),), False)
    assert SymbolicConstant().name != SymbolicConstant().name
