"""Running a program file over a folder of facts: what its ``.input`` and ``.output`` directives ask for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from surmise.parser import parse
from surmise.plans.fixpoint import evaluate
from surmise.sources.facts import load_relations, schema_of, write_relations
from surmise.terms import Program


def run_program(spark: SparkSession, program: Program | str | os.PathLike, facts_dir: str | None = None, output_dir: str | None = None) -> dict[str, DataFrame]:
    """The relations that the program's ``.output`` directives name; ``output_dir`` gets them as files too.

    Its ``.input`` relations come from ``<relation>.facts`` or ``.csv`` in ``facts_dir`` (a relation without a file is
    empty), and its own facts count as well.
    """
    if not isinstance(program, Program):
        program = parse(program)
    for name in (*program.inputs, *program.outputs):
        if name not in program.declarations:
            raise ValueError(f"the relation {name!r} is not declared")
    if program.inputs and facts_dir is None:
        raise ValueError("the program has .input relations: say where their files are")
    given = load_relations(spark, facts_dir, program.declarations, program.inputs) if program.inputs else {}
    given |= {name: spark.createDataFrame([], schema_of(program.declarations[name])) for name in program.inputs if name not in given}
    found = evaluate(spark, program.rules, given, program.declarations, list(program.outputs), program.facts)
    out = {name: found[name] if name in found else spark.createDataFrame([], schema_of(program.declarations[name])) for name in program.outputs}
    if output_dir is not None:
        write_relations(output_dir, out)
    return out
