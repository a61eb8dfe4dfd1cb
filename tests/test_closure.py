"""Closures over contracted groups, and joins by lists of partners, against a plain search."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from surmise.operators import rules as joins
from surmise.parser import parse_text
from surmise.plans import closure, fixpoint
from surmise.plans.fixpoint import Fixpoint

RIGHT, LEFT, BOTH = "q(x, z) :- e(x, y), q(y, z).", "q(x, z) :- q(x, y), e(y, z).", "q(x, z) :- q(y, z), q(x, y)."


def _close(spark, text, edges, kind="string"):
    df = spark.createDataFrame(edges, f"v0 {kind}, v1 {kind}")
    types = ["number" if kind == "long" else "symbol"] * 2
    f = Fixpoint(spark, parse_text(text).rules, {"e": df}, {"e": types, "q": types})
    got = list(map(tuple, f.run(["q"])["q"].collect()))
    assert len(got) == len(set(got))
    return f, set(got)


def _reached(edges):
    after, out = {}, set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for start in after:
        todo = list(after[start])
        while todo:
            if (start, (n := todo.pop())) not in out:
                out.add((start, n))
                todo += after.get(n, ())
    return out


def _graph(rng):
    """Cycles of several sizes, paths into, between and out of them, own loops, a part without cycles."""
    edges = [(f"c{k}_{i}", f"c{k}_{(i + 1) % size}") for k, size in enumerate((7, 5, 3, 2)) for i in range(size)]
    edges += [("z1", "c0_1"), ("c0_3", "m"), ("m", "c1_0"), ("c1_2", "z2"), ("z2", "a"), ("loop", "loop"), ("a", "loop"), ("c3_0", "z1")]
    nodes = [f"d{i}" for i in range(12)]
    return edges + [(a, b) for a in nodes for b in nodes if a < b and rng.random() < 0.2] + [("d3", "c2_0")]


@pytest.mark.parametrize("step, limits", [(RIGHT, {}), (LEFT, {"BLOCK": 2}), (BOTH, {"LOCAL_EDGES": 0}), (RIGHT, {"LOCAL_EDGES": 0, "MOST_ROUNDS": 1, "BLOCK": 2}), (LEFT, {"LOCAL_EDGES": 10, "MOST_ROUNDS": 2})])
def test_closures_equal_a_plain_search(spark, monkeypatch, step, limits):
    """Also where rounds run out before the groups are found."""
    for name, value in limits.items():
        monkeypatch.setattr(closure, name, value)
    edges = _graph(random.Random(3))
    assert _close(spark, f"q(x, y) :- e(x, y). {step}", edges)[1] == _reached(edges)


@pytest.mark.parametrize("step", [RIGHT, LEFT, BOTH])
def test_a_cycle_is_closed_in_few_rounds(spark, step):
    edges = [(i, (i + 1) % 60) for i in range(60)]
    f, got = _close(spark, f"q(x, y) :- e(x, y). {step}", edges, "long")
    assert got == {(a, b) for a in range(60) for b in range(60)} and f.rounds <= 2


def test_a_closure_stores_no_pairs_of_a_cycle(spark):
    f, got = _close(spark, "q(x, y) :- e(x, y). " + LEFT, [(i, (i + 1) % 60) for i in range(60)], "long")
    files = Path(f.store.root.removeprefix("file://")).rglob("*.parquet")
    assert len(got) == 3600 and 0 < sum(pq.ParquetFile(p).metadata.num_rows for p in files) < 600


def test_only_closures_are_contracted(spark):
    """Rules that look alike but aren't closures of one relation."""
    for text in (
        "q(x, y) :- e(y, x). " + RIGHT,
        "q(x, x) :- e(x, _). " + LEFT,
        "q(x, y) :- e(x, y). q(x, z) :- e(x, y), q(z, y).",
        "q(x, y) :- e(x, y). q(x, y) :- e(y, x). " + RIGHT,
        "q(x, y) :- e(x, y). q(x, z) :- e(x, y), f(y, z).",
        "q(x, y) :- e(x, y). q(x, x) :- e(x, y), q(y, x).",
    ):
        assert closure.closure_rules("q", parse_text(text).rules, False) is None, text
    assert closure.closure_rules("q", parse_text("q(x, y) :- e(x, y). " + RIGHT).rules, True) is None
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    both = edges + [(b, a) for a, b in edges]
    assert _close(spark, "q(x, y) :- e(x, y). q(x, y) :- e(y, x). " + BOTH, edges)[1] == _reached(both)


def test_squared_closures_of_any_start(spark):
    """q(x, z) :- q(x, y), q(y, z) closes whatever the plain rules derive, given tuples too."""
    rules = parse_text("q(x, y) :- e(y, x). " + BOTH).rules
    edges, own = [("b", "a"), ("c", "b"), ("a", "c")], [("c", "d"), ("d", "x")]
    kind = "v0 string, v1 string"
    f = Fixpoint(spark, rules, {"e": spark.createDataFrame(edges, kind), "q": spark.createDataFrame(own, kind)}, {n: ["symbol"] * 2 for n in "eq"})
    assert set(map(tuple, f.run(["q"])["q"].collect())) == _reached([(b, a) for a, b in edges] + own) and f.rounds <= 3


@pytest.mark.parametrize("rule, kind", [("q(a, b) :- e(a, p), e(b, p).", "long"), ("q(b, 7, a) :- e(p, a), e(p, b).", "long"), ("q(a, b) :- e(a, p), e(p, b).", "string")])
def test_self_joins_shuffle_no_pairs(spark, monkeypatch, rule, kind):
    """Every pair once, for frequent keys too; no exchange carries both ends of a pair."""
    monkeypatch.setattr(fixpoint, "LARGE", 1)
    monkeypatch.setattr(joins, "MOST_PARTNERS", 3)
    rng = random.Random(5)
    edges = list({(rng.randint(-9, 40), rng.randint(0, 40)) for _ in range(150)} | {(i, 1) for i in range(30)} | {(1, i) for i in range(30)})
    if kind == "string":
        edges = [tuple(map(str, e)) for e in edges]
    parsed = parse_text(rule).rules
    at = [[a.name for a in x.args] for x in parsed[0].body]
    rows = [dict(zip(at[0], x, strict=True)) | dict(zip(at[1], y, strict=True)) for x in edges for y in edges if x[at[0].index("p")] == y[at[1].index("p")]]
    expected = {tuple(r[v.name] if hasattr(v, "name") else 7 for v in parsed[0].head.args) for r in rows}
    types = ["number" if kind == "long" else "symbol"] * 2
    q = Fixpoint(spark, parsed, {"e": spark.createDataFrame(edges, f"v0 {kind}, v1 {kind}")}, {"e": types, "q": types + ["number"] * (len(parsed[0].head.args) - 2)}).run(["q"])["q"]
    got = list(map(tuple, q.collect()))
    assert len(got) == len(set(got)) and set(got) == expected
    assert "hashpartitioning(x_a" not in q._jdf.queryExecution().executedPlan().toString()


def test_no_empty_self_join(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "LARGE", 0)
    rules = parse_text("q(a, b) :- e(a, p), e(b, p).").rules
    f = Fixpoint(spark, rules, {"e": spark.createDataFrame([], "v0 long, v1 long")}, {n: ["number"] * 2 for n in "eq"})
    assert f.run(["q"])["q"].count() == 0


@pytest.mark.parametrize("step", [RIGHT, LEFT, BOTH])
@pytest.mark.parametrize("limits, local", [({}, True), ({"ARROW_PAIRS": 1, "BLOCK": 3}, True), ({"LOCAL_GROUPS": 5, "BROADCAST_NODES": 0}, False)])
def test_small_graphs_are_closed_by_one_task(spark, monkeypatch, step, limits, local):
    """No rounds of joins, unless the graph of groups is large; nodes of several blocks, by Arrow or not."""
    for name, value in limits.items():
        monkeypatch.setattr(closure, name, value)
    edges = _graph(random.Random(4))
    f, got = _close(spark, "q(x, y) :- e(x, y). " + step, edges)
    assert got == _reached(edges) and (f.rounds == 0) == local


def test_empty_and_looping_graphs(spark):
    for edges in ([], [(1, 1)], [(1, 1), (1, 2)], [(2, 1), (1, 2)]):
        assert _close(spark, "q(x, y) :- e(x, y). " + BOTH, edges, "long")[1] == _reached(edges)


def test_results_of_a_cycle_shrink_in_parquet(spark, tmp_path):
    """Bytes of the written result a row: runs of x, repeating codes of y."""
    n = 1501
    types = {"e": ["number"] * 2, "q": ["number"] * 2}
    df = spark.createDataFrame([(7 * i, 7 * ((i + 1) % n)) for i in range(n)], "v0 long, v1 long")
    q = Fixpoint(spark, parse_text("q(x, y) :- e(x, y). " + LEFT).rules, {"e": df}, types).run(["q"])["q"]
    q.write.parquet(f"file://{tmp_path}/q")
    files = list((tmp_path / "q").glob("*.parquet"))
    got = {(x, y) for f in files for x, y in zip(*(c.to_pylist() for c in pq.read_table(f).columns), strict=True)}
    assert len(got) == sum(pq.ParquetFile(f).metadata.num_rows for f in files) == n * n
    assert sum(f.stat().st_size for f in files) < 0.4 * n * n


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_NODES": 0}])
def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch, limits):
    """Whatever joins Spark chooses: their exchanges count bytes, and few bytes become many pairs."""
    for name, value in (limits | {"TASK_PAIRS": 1000, "BLOCK": 8}).items():
        monkeypatch.setattr(closure, name, value)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        types = {"e": ["number"] * 2, "q": ["number"] * 2}
        df = spark.createDataFrame([(i, (i + 1) % 90) for i in range(90)], "v0 long, v1 long")
        q = Fixpoint(spark, parse_text("q(x, y) :- e(x, y). " + LEFT).rules, {"e": df}, types).run(["q"])["q"]
        parts = q.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(parts) == 8100 and sum(k > 0 for k in parts) >= 8 and max(parts) < 2500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_file_of_a_large_result_has_one_block_of_second_nodes(spark, tmp_path):
    """So the codes of y fill a byte and repeat byte by byte; nodes that share no block and small groups are whole too."""
    n = 2500
    edges = [(3 * i, 3 * ((i + 1) % n)) for i in range(n)] + [(7, 0)] + [(10**6 + k, 10**6 + (k + 1 if k % 40 < 39 else k - 39)) for k in range(400)]
    df = spark.createDataFrame(edges, "v0 long, v1 long")
    types = {"e": ["number"] * 2, "q": ["number"] * 2}
    q = Fixpoint(spark, parse_text("q(x, y) :- e(x, y). " + LEFT).rules, {"e": df}, types).run(["q"])["q"]
    q.write.parquet(f"file://{tmp_path}/q")
    tables = {f: pq.read_table(f) for f in (tmp_path / "q").glob("*.parquet")}
    large = [f for f, t in tables.items() if t.num_rows > 100_000]
    assert len(large) >= 10 and all(len(tables[f].column(1).unique()) <= 256 for f in large)
    assert sum(t.num_rows for t in tables.values()) == n * n + n + 400 * 40
    got = spark.read.parquet(f"file://{tmp_path}/q").toDF("x", "y").distinct().groupBy("x").count().groupBy("count").count().collect()
    assert {tuple(r) for r in got} == {(n, n + 1), (40, 400)}
    assert sum(f.stat().st_size for f in large) < 0.12 * sum(tables[f].num_rows for f in large)


def test_blocks_of_searched_groups_are_full(spark, monkeypatch):
    monkeypatch.setattr(closure, "BLOCK", 3)
    members = spark.createDataFrame([(i, i % 2) for i in range(1000)], "v long, c long")
    rows = closure.blocked(Fixpoint(spark, [], {}, {}).store, members).collect()
    assert len({(r.c, r.block) for r in rows}) == len(rows) and max(len(r.vs) for r in rows) == 3 and sum(len(r.vs) < 3 for r in rows) <= 6
    assert sorted((v, r.c) for r in rows for v in r.vs) == [(i, i % 2) for i in range(1000)]
