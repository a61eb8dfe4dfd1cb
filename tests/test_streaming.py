"""Input that arrives in batches gives what input given at once does."""

from surmise.api import evaluate, parse_text, to_frame
from surmise.streaming.incremental import Incremental

PROGRAM = parse_text('p(x, y) :- e(x, y). p(x, z) :- p(x, y), p(y, z). e("a", "b"). e("c", "d"). e("b", "c"). e("d", "a").')
TYPES = {"e": ("symbol", "symbol"), "p": ("symbol", "symbol")}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_batches(spark):
    facts = sorted(PROGRAM.facts, key=str)
    whole = evaluate(spark, PROGRAM.rules, {}, TYPES, None, facts)
    kept = Incremental(spark, PROGRAM.rules, {"e": to_frame(spark, facts[:2], TYPES["e"])}, TYPES)
    assert rows(kept.relations["p"]) == rows(evaluate(spark, PROGRAM.rules, {}, TYPES, None, facts[:2])["p"])
    for fact in facts[2:]:
        kept.add("e", to_frame(spark, [fact], TYPES["e"]))
    assert rows(kept.relations["p"]) == rows(whole["p"])


def test_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    to_frame(spark, PROGRAM.facts, TYPES["e"]).write.parquet(source)
    kept = Incremental(spark, PROGRAM.rules, {}, TYPES)
    stream = spark.readStream.schema("v0 string, v1 string").parquet(source).writeStream.foreachBatch(kept.writer("e")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert len(rows(kept.relations["p"])) == 16
