"""Registered queries: Datalog programs over the tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surmise.functions.delta import ddmin, ddmin_all
from surmise.operators.tuples import contained, divide, holds_number, merge_by_key, same_rows, substitute_values
from surmise.parser import parse_text
from surmise.plans.files import run_program
from surmise.plans.fixpoint import evaluate
from surmise.plans.symbolic import SymbolicPlan, is_sentinel, repair, symex
from surmise.plans.views import VIEWS, with_views
from surmise.sources.facts import fact_text, load_relations, types_of, write_relations
from surmise.sources.store import Store
from surmise.terms import SYM, Fact, Literal, Rule, String, Symbol, Variable

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
ALPHA, NEW_BRAND = Symbol("alpha"), "Brand#NEW"
BULK_RULES = parse_text("q(r, b) :- nation_in(n, r), bulk(n, b).").rules


def _views(spark: SparkSession, d: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: VIEWS[n](spark, d) for n in names}


def datalog(name: str, text: str, views: Sequence[str], columns: Sequence[str], sql: str, out: str = "q", recursive: str = "") -> None:
    """Register the relation ``out`` of a program over views."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        program = parse_text(text)
        found = evaluate(spark, program.rules, _views(spark, d, views), program.declarations, [out], program.facts)
        return found[out].toDF(*columns)

    _QUERIES[name] = query
    _SQL[name] = with_views(views, sql, recursive)


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


datalog("scan_project", "q(x) :- supplies(x, _).", ["supplies"], ["x"], "SELECT DISTINCT x FROM supplies")
datalog("const_filter", 'q(x) :- nation_in(x, "ASIA").', ["nation_in"], ["x"], "SELECT x FROM nation_in WHERE y = 'ASIA'")
datalog("repeat_var", "q(x) :- follows(x, x).", ["follows"], ["x"], "SELECT x FROM follows WHERE x = y")
datalog("const_head", 'q("k", x, x) :- part_of(x, _).', ["part_of"], ["k", "x", "x2"], "SELECT DISTINCT 'k' AS k, x, x AS x2 FROM part_of")
datalog("equi_join", "q(r, b) :- nation_in(n, r), bulk(n, b).", ["nation_in", "bulk"], ["r", "b"], "SELECT DISTINCT nation_in.y r, bulk.y b FROM nation_in JOIN bulk ON nation_in.x = bulk.x")
datalog("three_way_join", "q(c, n, r) :- part_of(c, n), part_of(n, r), region_name(r).", ["part_of", "region_name"], ["c", "n", "r"], "SELECT DISTINCT a.x c, a.y n, b.y r FROM part_of a JOIN part_of b ON a.y = b.x JOIN region_name ON region_name.x = b.y")
datalog("self_join_same_part", "q(a, b) :- supplies(a, p), supplies(b, p).", ["supplies"], ["a", "b"], "SELECT DISTINCT s.x a, t.x b FROM supplies s JOIN supplies t ON s.y = t.y")
datalog("cross_product", "q(x, y) :- region_name(x), region_name(y).", ["region_name"], ["x", "y"], "SELECT DISTINCT a.x x, b.x y FROM region_name a CROSS JOIN region_name b")
datalog("semi_join", "q(x, r) :- nation_in(x, r), bulk(x, _).", ["nation_in", "bulk"], ["x", "r"], "SELECT x, y AS r FROM nation_in WHERE EXISTS (SELECT 1 FROM bulk WHERE bulk.x = nation_in.x)")
datalog("union_rules", "q(n, b) :- bulk(n, b). q(n, b) :- returned(n, b).", ["bulk", "returned"], ["n", "b"], "SELECT x AS n, y AS b FROM bulk UNION SELECT x, y FROM returned")
datalog("intersection", "q(n, b) :- bulk(n, b), returned(n, b).", ["bulk", "returned"], ["n", "b"], "SELECT x AS n, y AS b FROM bulk INTERSECT SELECT x, y FROM returned")
datalog("contains_filter", 'q(n) :- part_name(n), contains("ring", n).', ["part_name"], ["n"], "SELECT x AS n FROM part_name WHERE contains(x, 'ring')")

_CLOSURE = "t AS (SELECT x, y FROM {0} UNION SELECT t.x, e.y FROM t JOIN {0} e ON t.y = e.x)"
for _name, _second in (("tc_linear_right", "follows(x, y), q(y, z)"), ("tc_linear_left", "q(x, y), follows(y, z)"), ("tc_nonlinear", "q(x, y), q(y, z)")):
    datalog(_name, f"q(x, y) :- follows(x, y). q(x, z) :- {_second}.", ["follows"], ["x", "y"], "SELECT x, y FROM t", recursive=_CLOSURE.format("follows"))
datalog("tc_dag_hierarchy", "q(x, y) :- part_of(x, y). q(x, z) :- part_of(x, y), q(y, z).", ["part_of"], ["x", "y"], "SELECT x, y FROM t", recursive=_CLOSURE.format("part_of"))
_CHAIN = "t AS (SELECT c, x, y FROM next_turn UNION SELECT t.c, t.x, e.y FROM t JOIN next_turn e ON t.c = e.c AND t.y = e.x)"
datalog("tc_chain_conversation", "q(c, x, y) :- next_turn(c, x, y). q(c, x, z) :- next_turn(c, x, y), q(c, y, z).", ["next_turn"], ["c", "x", "y"], "SELECT c, x, y FROM t", recursive=_CHAIN)
datalog(
    "mutual_even_odd",
    "odd(c, x, y) :- next_turn(c, x, y). odd(c, x, z) :- next_turn(c, x, y), even(c, y, z). even(c, x, z) :- next_turn(c, x, y), odd(c, y, z). q(c, x, y, 0) :- even(c, x, y). q(c, x, y, 1) :- odd(c, x, y).",
    ["next_turn"],
    ["c", "x", "y", "parity"],
    "SELECT c, x, y, parity FROM t",
    recursive="t AS (SELECT c, x, y, 1::BIGINT AS parity FROM next_turn UNION SELECT t.c, t.x, e.y, 1 - parity FROM t JOIN next_turn e ON t.c = e.c AND t.y = e.x)",
)
datalog("same_generation", "q(x, y) :- nation_in(x, p), nation_in(y, p). q(x, y) :- nation_in(x, a), q(a, b), nation_in(y, b).", ["nation_in"], ["x", "y"], "SELECT DISTINCT x, y FROM t",
        recursive="t AS (SELECT a.x, b.x AS y FROM nation_in a JOIN nation_in b ON a.y = b.y UNION SELECT a.x, b.x FROM t JOIN nation_in a ON a.y = t.x JOIN nation_in b ON b.y = t.y)")
datalog("facts_plus_rules", 'e("EARTH", "SUN"). e(x, y) :- nation_in(x, y). e(r, "EARTH") :- region_name(r). q(x, y) :- e(x, y). q(x, z) :- e(x, y), q(y, z).', ["nation_in", "region_name"], ["x", "y"], "SELECT x, y FROM t",
        recursive="e AS (SELECT x, y FROM nation_in UNION SELECT x, 'EARTH' FROM region_name UNION SELECT 'EARTH', 'SUN'), " + _CLOSURE.format("e"))


@query("negation_strat", with_views(["nation_in", "brand", "bulk"], "SELECT nation_in.x n, brand.x b FROM nation_in CROSS JOIN brand EXCEPT SELECT x, y FROM bulk"))
def negation_strat(spark: SparkSession, d: str) -> DataFrame:
    n, b = Variable("n"), Variable("b")
    rule = Rule(Literal("q", (n, b)), (Literal("nation_in", (n, Variable("r"))), Literal("brand", (b,)), Literal("bulk", (n, b), False)))
    return evaluate(spark, [rule], _views(spark, d, ["nation_in", "brand", "bulk"]), None, ["q"])["q"].toDF("n", "b")


def _alpha_plan(spark: SparkSession, d: str) -> SymbolicPlan:
    """A sale of a new brand to an unknown nation, beside the known sales."""
    return SymbolicPlan(spark, BULK_RULES, [Fact(Literal("bulk", (ALPHA, String(NEW_BRAND))))], _views(spark, d, ["nation_in", "bulk"]))


def _shown(column: str):
    return F.when(is_sentinel(F.col(column), SYM), "?").otherwise(F.col(column)).alias(column)


_DOMAIN = "dom AS (SELECT x AS alpha FROM nation_in UNION SELECT x FROM bulk UNION SELECT '?')"


@query("sym_domain", with_views(["nation_in", "bulk"], "SELECT alpha FROM dom").replace(") SELECT alpha", f"), {_DOMAIN} SELECT alpha"))
def sym_domain(spark: SparkSession, d: str) -> DataFrame:
    return _alpha_plan(spark, d).domains.values["alpha"].toDF("alpha").select(_shown("alpha"))


_META_JOIN = f"{_DOMAIN}, facts AS (SELECT x, y, alpha FROM bulk CROSS JOIN dom UNION SELECT alpha, '{NEW_BRAND}', alpha FROM dom)"


@query("sym_meta_join", with_views(["nation_in", "bulk"], "SELECT DISTINCT n.y r, f.y b, alpha FROM nation_in n JOIN facts f ON n.x = f.x").replace(") SELECT DISTINCT n.y", f"), {_META_JOIN} SELECT DISTINCT n.y"))
def sym_meta_join(spark: SparkSession, d: str) -> DataFrame:
    return _alpha_plan(spark, d).evaluate(["q"])["q"].toDF("r", "b", "alpha").select("r", "b", _shown("alpha"))


_META_TC = "dom AS (SELECT x AS alpha FROM nation_in UNION SELECT y FROM nation_in UNION SELECT 'ASIA' UNION SELECT '?'), e AS (SELECT x, y, alpha FROM nation_in CROSS JOIN dom UNION SELECT 'ASIA', alpha, alpha FROM dom), t AS (SELECT x, y, alpha FROM e UNION SELECT t.x, e.y, t.alpha FROM t JOIN e ON t.y = e.x AND t.alpha = e.alpha)"


@query("sym_meta_tc", with_views(["nation_in"], "SELECT x, y, alpha FROM t", _META_TC))
def sym_meta_tc(spark: SparkSession, d: str) -> DataFrame:
    rules = parse_text("q(x, y) :- nation_in(x, y). q(x, z) :- nation_in(x, y), q(y, z).").rules
    plan = SymbolicPlan(spark, rules, [Fact(Literal("nation_in", (String("ASIA"), ALPHA)))], _views(spark, d, ["nation_in"]))
    return plan.evaluate(["q"])["q"].toDF("x", "y", "alpha").select(_shown("x"), _shown("y"), _shown("alpha"))


@query("sym_match", with_views(["region_name"], "SELECT 'to ' || x AS target, x AS r, alpha FROM region_name, dom WHERE alpha = '?' OR alpha = x").replace(") SELECT 'to '", "), dom AS (SELECT x AS alpha FROM region_name UNION SELECT '?') SELECT 'to '"))
def sym_match(spark: SparkSession, d: str) -> DataFrame:
    """An unknown region among the outputs is matched with every region asked for; its domain are the values that a join can bring it."""
    regions = VIEWS["region_name"](spark, d)
    rules = parse_text("q(x) :- known(x). listed(x) :- known(x), region_name(x).").rules
    plan = SymbolicPlan(spark, rules, [Fact(Literal("known", (ALPHA,)))], {"region_name": regions})
    asked = regions.select(F.concat(F.lit("to "), "v0").alias("target"), F.col("v0").alias("t0"))
    found = plan.evaluate(["q"])["q"]
    return plan.matches(found, "q", asked).select("target", F.col("t0").alias("r"), F.col("v1").alias("alpha")).select("target", "r", _shown("alpha"))


def _ways(spark: SparkSession, rules, relations: dict[str, DataFrame], asked: DataFrame, one: bool = False) -> DataFrame:
    """(t..., fact): the signed facts of each minimal support, or of one support, of each asked tuple of q."""
    plan = SymbolicPlan(spark, rules, [], relations)
    columns = [f"t{i}" for i in range(len(asked.columns))]
    named = asked.toDF(*columns)
    targets = named.select(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("target"), *columns)
    ways = plan.ways({"q": targets}, one=one)
    facts = ways.select(F.col("target").alias("of"), F.explode(F.transform(F.filter("support", lambda e: e.startswith("s:")), lambda e: F.substring(e, 3, 1 << 30))).alias("fact"))
    return facts.join(targets, F.col("of") == F.col("target")).select(*columns, "fact").distinct()


_WHY = """SELECT DISTINCT nation_in.y r, bulk.y b, 'bulk("' || bulk.x || '", "' || bulk.y || '").' AS fact FROM nation_in JOIN bulk ON nation_in.x = bulk.x"""


@query("why_join", with_views(["nation_in", "bulk"], _WHY))
def why_join(spark: SparkSession, d: str) -> DataFrame:
    views = _views(spark, d, ["nation_in", "bulk"])
    asked = evaluate(spark, BULK_RULES, views, None, ["q"])["q"]
    return _ways(spark, BULK_RULES, views | {"bulk": views["bulk"].withColumn("sign", F.lit(True))}, asked).toDF("r", "b", "fact")


@query("why_one", with_views(["nation_in", "bulk"], f"SELECT r, b, min(fact) AS fact FROM ({_WHY}) GROUP BY r, b"))
def why_one(spark: SparkSession, d: str) -> DataFrame:
    """One support of each tuple, however many there are: here the first of the smallest."""
    views = _views(spark, d, ["nation_in", "bulk"])
    asked = evaluate(spark, BULK_RULES, views, None, ["q"])["q"]
    return _ways(spark, BULK_RULES, views | {"bulk": views["bulk"].withColumn("sign", F.lit(True))}, asked, one=True).toDF("r", "b", "fact")


@query("sign_filter", with_views(["nation_in", "bulk"], _WHY + " WHERE bulk.y LIKE '%1'"))
def sign_filter(spark: SparkSession, d: str) -> DataFrame:
    """Only some facts are uncertain: supports name these alone."""
    views = _views(spark, d, ["nation_in", "bulk"])
    asked = evaluate(spark, BULK_RULES, views, None, ["q"])["q"]
    return _ways(spark, BULK_RULES, views | {"bulk": views["bulk"].withColumn("sign", F.col("v1").endswith("1"))}, asked).toDF("r", "b", "fact")


@query("why_chain", with_views(["next_turn"], "SELECT t.c, t.x, t.y, 'next_turn(' || e.c || ', ' || e.x || ', ' || e.y || ').' AS fact FROM t JOIN next_turn e ON t.c = e.c AND e.x >= t.x AND e.y <= t.y", _CHAIN))
def why_chain(spark: SparkSession, d: str) -> DataFrame:
    rules = parse_text("q(c, x, y) :- next_turn(c, x, y). q(c, x, z) :- next_turn(c, x, y), q(c, y, z).").rules
    edges = VIEWS["next_turn"](spark, d)
    asked = evaluate(spark, rules, {"next_turn": edges}, None, ["q"])["q"]
    return _ways(spark, rules, {"next_turn": edges.withColumn("sign", F.lit(True))}, asked).toDF("c", "x", "y", "fact")


def _region_targets() -> list[Fact]:
    return [Fact(Literal("q", (String(r), String(NEW_BRAND)))) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]


@query("symex_flagship", with_views(["nation_in"], f"""SELECT 'q("' || y || '", "{NEW_BRAND}").' AS target, CASE WHEN count(*) = 1 THEN min('alpha == "' || x || '"') ELSE 'Or(' || string_agg('alpha == "' || x || '"', ', ' ORDER BY x) || ')' END AS condition FROM nation_in GROUP BY y"""))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which value of the unknown nation puts the new brand into each region?"""
    facts = [Fact(Literal("bulk", (ALPHA, String(NEW_BRAND))))]
    found = symex(spark, BULK_RULES, facts, _region_targets(), _views(spark, d, ["nation_in", "bulk"]))
    return spark.createDataFrame(sorted((str(t), str(c)) for t, c in found.items()), "target string, condition string")


@query("repair_demo", with_views(["nation_in"], "SELECT 'alpha' AS symbol, min(x) AS value FROM nation_in WHERE y = 'ASIA'"))
def repair_demo(spark: SparkSession, d: str) -> DataFrame:
    wanted, unwanted = _region_targets()[2:3], _region_targets()[3:4]
    model = repair(spark, BULK_RULES, [Fact(Literal("bulk", (ALPHA, String(NEW_BRAND))))], wanted, unwanted, _views(spark, d, ["nation_in", "bulk"]))
    return spark.createDataFrame([(s, str(v)) for s, v in model[0].items()] if model else [], "symbol string, value string")


@query("ddmin_demo", with_views(["nation_in", "bulk"], """SELECT kind, 'bulk("' || bulk.x || '", "' || bulk.y || '").' AS fact FROM bulk JOIN nation_in ON nation_in.x = bulk.x CROSS JOIN (VALUES ('all', 1), ('any', 2)) AS k(kind, n) WHERE nation_in.y = 'ASIA' AND bulk.y LIKE '%1'"""))
def ddmin_demo(spark: SparkSession, d: str) -> DataFrame:
    """Which sales trip a test?  One that every suspect trips (all minimal sets), and one that they trip together (one set).

    The sales are pairs of a nation and a brand, so their number is bounded by those, not by the tables.
    """
    df = VIEWS["bulk"](spark, d)
    suspects = df.join(VIEWS["nation_in"](spark, d).where("v1 = 'ASIA'").select(F.col("v0").alias("n")), F.col("v0") == F.col("n"), "left_semi").where("v1 LIKE '%1'")
    printed = lambda x: [r[0] for r in x.select(fact_text("bulk", types_of(df), ["v0", "v1"])).collect()]
    items, wanted = sorted(printed(df)), set(printed(suspects))
    rows = [("any", x) for found in ddmin_all(lambda part: bool(wanted & set(part)), items) for x in found]
    rows += [("all", x) for x in ddmin(lambda part: wanted <= set(part), items) or []]
    return spark.createDataFrame(rows, "kind string, fact string")


@query("substitute", with_views(["nation_in"], "SELECT DISTINCT CASE WHEN x = 'CHINA' THEN 'alpha' ELSE x END AS x, CASE WHEN y = 'CHINA' THEN 'alpha' ELSE y END AS y FROM nation_in"))
def substitute_demo(spark: SparkSession, d: str) -> DataFrame:
    return substitute_values(VIEWS["nation_in"](spark, d), {"CHINA": "alpha"}).distinct().toDF("x", "y")


_ODD = """SELECT x || chr(9) || '"' || chr(10) || '\\n\\' || y AS x, CASE WHEN y = 'ASIA' THEN '' ELSE y END AS y FROM part_of"""


@query("tsv_roundtrip", with_views(["part_of"], _ODD))
def tsv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with tabs, line ends, quotes and backslashes, and empty ones, written to files and read back."""
    folder = Store(spark).root
    df = VIEWS["part_of"](spark, d).select(F.concat("v0", F.lit('\t"\n\\n\\'), "v1").alias("v0"), F.when(F.col("v1") == "ASIA", "").otherwise(F.col("v1")).alias("v1"))
    write_relations(folder, {"part_of": df})
    return load_relations(spark, folder, {"part_of": types_of(df)})["part_of"].toDF("x", "y")


@query("empty_text", with_views(["region_name"], "SELECT CASE WHEN x = 'ASIA' THEN '' ELSE x END AS x FROM region_name"))
def empty_text(spark: SparkSession, d: str) -> DataFrame:
    """In a relation of one text column, an empty line is a tuple."""
    folder = Store(spark).root
    df = VIEWS["region_name"](spark, d).select(F.when(F.col("v0") == "ASIA", "").otherwise(F.col("v0")).alias("v0"))
    write_relations(folder, {"r": df})
    return load_relations(spark, folder, {"r": types_of(df)})["r"].toDF("x")


PROGRAM = """
// The turns that can be reached within a conversation.
.decl next_turn(c: number, x: number, y: number)
.decl later(c: number, x: number, y: number)
.input next_turn
.output later
next_turn(-1, 0, 1). next_turn(-1, 1, 2).
later(c, x, y) :- next_turn(c, x, y).
later(c, x, z) :- next_turn(c, x, y), later(c, y, z).  // linear
"""


@query("program_file", with_views(["next_turn"], "SELECT c, x, y FROM t", "e AS (SELECT c, x, y FROM next_turn UNION SELECT -1, 0, 1 UNION SELECT -1, 1, 2), " + _CHAIN.replace("next_turn", "e")))
def program_file(spark: SparkSession, d: str) -> DataFrame:
    """A program's text over a folder of facts, as its directives say; its result is written and read back."""
    root, program = Store(spark).root, parse_text(PROGRAM)
    write_relations(f"{root}/facts", {"next_turn": VIEWS["next_turn"](spark, d)})
    run_program(spark, program, f"{root}/facts", f"{root}/out")
    return load_relations(spark, f"{root}/out", program.declarations)["later"].toDF("c", "x", "y")


@query("merge_by_key", with_views(["bulk"], "SELECT x AS n, string_agg(y, ',' ORDER BY y) AS brands FROM bulk GROUP BY x"))
def merged_by_key(spark: SparkSession, d: str) -> DataFrame:
    found = merge_by_key(VIEWS["bulk"](spark, d).toDF("n", "b"), "n", "b")
    return found.select("n", F.array_join("values", ",").alias("brands"))


_LINES = "SELECT {0} AS k FROM lineitem WHERE l_quantity >= {1}"


@query("divide_multiset", f"SELECT 'both' AS part, k, count(*) AS n FROM ({_LINES.format('l_suppkey', 45)} INTERSECT ALL {_LINES.format('l_suppkey', 48)}) GROUP BY k UNION ALL SELECT 'rest', k, count(*) FROM ({_LINES.format('l_suppkey', 45)} EXCEPT ALL {_LINES.format('l_suppkey', 48)}) GROUP BY k")
def divided(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table that another one accounts for, and the others, as multisets."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    of = lambda least: lines.where(F.col("l_quantity") >= least).select(F.col("l_suppkey").alias("k"))
    both, rest = divide(of(45), of(48))
    counted = lambda df, name: df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "k", "n")
    return counted(both, "both").unionByName(counted(rest, "rest"))


@query("relation_tests", with_views(["bulk", "returned"], "SELECT (SELECT count(*) FROM (SELECT * FROM bulk INTERSECT SELECT * FROM returned) i) = (SELECT count(*) FROM bulk) AS within, (SELECT count(*) FROM bulk) = (SELECT count(*) FROM (SELECT * FROM bulk UNION SELECT * FROM returned) u) AND (SELECT count(*) FROM returned) = (SELECT count(*) FROM bulk) AS same"))
def relation_tests(spark: SparkSession, d: str) -> DataFrame:
    """Whether one relation is within another, and whether both are equal."""
    a, b = VIEWS["bulk"](spark, d), VIEWS["returned"](spark, d)
    return spark.createDataFrame([(contained(a, b), same_rows(a, b))], "within boolean, same boolean")


@query("cell_kinds", "SELECT x, try_cast(x AS BIGINT) IS NOT NULL AS number FROM (SELECT DISTINCT p_size::VARCHAR x FROM part UNION SELECT DISTINCT p_brand FROM part)")
def cell_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Which texts of a relation are whole numbers."""
    part = spark.read.parquet(f"{d}/part.parquet")
    texts = part.select(F.col("p_size").cast("string").alias("x")).unionByName(part.select(F.col("p_brand").alias("x"))).distinct()
    return texts.select("x", holds_number(F.col("x")).alias("number"))


@query("pretty_facts", with_views(["bulk"], """SELECT 'bulk("' || x || '", "' || y || '").' AS fact FROM bulk"""))
def pretty_facts(spark: SparkSession, d: str) -> DataFrame:
    df = VIEWS["bulk"](spark, d)
    return df.select(fact_text("bulk", types_of(df), df.columns).alias("fact"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
