"""Relations in files and frames, and operations on whole relations."""

import pytest

from surmise.api import load_facts, load_relations, relation, run_program, to_frame, write_facts, write_relations
from surmise.operators.tuples import contained, divide, flatten, is_arg_symbolic_or_wildcard, is_number, is_symbolic, merge_by_key, recursive_flatten, remove_duplicates, same_rows, substitute_values
from surmise.parser import parse_text
from surmise.sources.facts import fact_text
from surmise.terms import String, Symbol, Wildcard

FACTS = parse_text('edge("a", 1). edge("b c", -2). edge("q\\"", 3).').facts
DECL = {"edge": ("symbol", "number")}


def test_round_trip(spark, tmp_path):
    write_facts(spark, str(tmp_path / "d"), FACTS)
    assert load_facts(spark, str(tmp_path / "d"), DECL) == set(FACTS)


def test_files_of_both_kinds_are_tab_separated(spark, tmp_path):
    (tmp_path / "edge.facts").write_text("a\t1\na\t1\n")
    (tmp_path / "edge.csv").write_text("b,c\t2\n")
    rows = {tuple(r) for r in load_relations(spark, str(tmp_path), DECL)["edge"].collect()}
    assert rows == {("a", 1), ("b,c", 2)}
    assert load_relations(spark, str(tmp_path), DECL, names=["other"]) == {}


@pytest.mark.parametrize("line", ["a\tx", "a", "a\t1\t2", "surmise_symbolic_1\t1"])
def test_bad_rows_fail(spark, tmp_path, line):
    (tmp_path / "edge.facts").write_text(line + "\n")
    with pytest.raises(Exception, match="columns|number|reserved"):
        load_relations(spark, str(tmp_path), DECL)["edge"].collect()


def test_undeclared_and_unknown_types(spark, tmp_path):
    (tmp_path / "edge.facts").write_text("a\t1\n")
    with pytest.raises(ValueError):
        load_relations(spark, str(tmp_path), {})
    with pytest.raises(ValueError):
        load_relations(spark, str(tmp_path), {"edge": ("symbol", "float")})


def test_frames_as_relations(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), (None, 2, 3.0)], "x string, y int, z double")
    assert [tuple(r) for r in relation(df, ["x", "y"], nulls="drop").collect()] == [("a", 1)]
    with pytest.raises(Exception, match="column 'x' has a null cell"):
        relation(df, ["x", "y"]).collect()
    assert {tuple(r) for r in relation(df, ["y"]).collect()} == {(1,), (2,)}
    with pytest.raises(TypeError):
        relation(df, ["z"])
    with pytest.raises(ValueError):
        relation(df, ["x"], nulls="keep")


ODD = ["", "x\ny", "a\tb", 'q"', "\\n", "\\", "\\\\t", "\r\n", "\\\n", "plain"]


def test_any_text_is_written_and_read_back(spark, tmp_path):
    one, two = spark.createDataFrame([(x,) for x in ODD], "v0 string"), spark.createDataFrame([(x, y, i) for i, x in enumerate(ODD) for y in ODD], "v0 string, v1 string, v2 long")
    write_relations(str(tmp_path), {"one": one, "two": two})
    back = load_relations(spark, str(tmp_path), {"one": ("symbol",), "two": ("symbol", "symbol", "number")})
    assert {r.v0 for r in back["one"].collect()} == set(ODD)
    assert {tuple(r) for r in back["two"].collect()} == {tuple(r) for r in two.collect()}
    with pytest.raises(Exception, match="null cell"):
        write_relations(str(tmp_path), {"three": spark.createDataFrame([("a", None)], "v0 string, v1 string")})


def test_plain_backslashes_and_empty_lines(spark, tmp_path):
    (tmp_path / "r.facts").write_text("C:\\new\n\n")
    (tmp_path / "n.facts").write_text("1\n\n2\n")
    decl = {"r": ("symbol",), "n": ("number",)}
    assert {r.v0 for r in load_relations(spark, str(tmp_path), decl, ["r"], escapes=False)["r"].collect()} == {"C:\\new", ""}
    assert {r.v0 for r in load_relations(spark, str(tmp_path), decl, ["n"])["n"].collect()} == {1, 2}


def test_reserved_numbers_fail(spark, tmp_path):
    (tmp_path / "edge.facts").write_text(f"a\t{-(2**63) + 5}\n")
    with pytest.raises(Exception, match="reserved"):
        load_relations(spark, str(tmp_path), DECL)["edge"].collect()


def test_programs_run_by_their_directives(spark, tmp_path):
    text = '.decl e(x: symbol, y: number)\n.decl none(x: symbol)\n.decl q(x: symbol)\n.input e\n.input none\n.output q // what is asked\ne("own", 3).\nq(x) :- e(x, _). q(x) :- none(x).'
    (tmp_path / "p.dl").write_text(text)
    (tmp_path / "facts").mkdir()
    (tmp_path / "facts" / "e.facts").write_text("a\t1\nb\t2\n")
    found = run_program(spark, tmp_path / "p.dl", str(tmp_path / "facts"), str(tmp_path / "out"))
    assert set(found) == {"q"} and {r.v0 for r in found["q"].collect()} == {"a", "b", "own"}
    assert {f.args[0].value for f in load_facts(spark, str(tmp_path / "out"), {"q": ("symbol",)})} == {"a", "b", "own"}
    with pytest.raises(ValueError):
        run_program(spark, tmp_path / "p.dl")
    with pytest.raises(ValueError):
        run_program(spark, parse_text(".output q"))


def test_printed_facts(spark):
    df = to_frame(spark, FACTS, DECL["edge"])
    assert {r[0] for r in df.select(fact_text("edge", DECL["edge"], df.columns)).collect()} == {str(f) for f in FACTS}


def test_whole_relations(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "x string, y long")
    assert {tuple(r) for r in substitute_values(df, {"a": "z", 2: 5}).collect()} == {("z", 1), ("b", 5)}
    one = df.limit(1)
    assert contained(one, df) and not contained(df, one) and same_rows(df, df)
    both, rest = divide(df, spark.createDataFrame([("b", 2), ("c", 3)], "x string, y long"))
    assert both.count() == 1 and rest.count() == 2
    assert [tuple(r) for r in merge_by_key(df, "x", "y").orderBy("x").collect()] == [("a", [1]), ("b", [2])]
    marked = spark.createDataFrame([("surmise_symbolic_1", 1), ("a", -(2**63) + 1)], "s string, n long")
    assert [tuple(r) for r in marked.select(is_symbolic(marked.s, "string"), is_symbolic(marked.n, "bigint")).collect()] == [(True, False), (False, True)]


def test_lists():
    assert recursive_flatten([1, (2, [3]), {"x"}]) == [1, 2, 3, "x"]
    assert is_arg_symbolic_or_wildcard(Wildcard()) and is_arg_symbolic_or_wildcard(Symbol("a")) and not is_arg_symbolic_or_wildcard(String("a"))
    assert flatten([1, [2, [3, (4,)]]]) == [1, 2, 3, (4,)] and remove_duplicates([1, 2, 1]) == [1, 2]
    assert is_number("-3") and not is_number("3.5")
