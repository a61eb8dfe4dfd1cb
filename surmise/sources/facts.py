"""Relations from and to tab-separated files, and between facts and DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surmise.terms import LOWEST, NUM, POOL, RESERVED, SYM, Fact, Literal, Number, String

SPARK_TYPES = {SYM: T.StringType(), NUM: T.LongType()}


def column_type(name: str) -> T.DataType:
    if name not in SPARK_TYPES:
        raise ValueError(f"unknown column type {name!r}: only {SYM} and {NUM} are supported")
    return SPARK_TYPES[name]


def schema_of(types: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f"v{i}", column_type(t)) for i, t in enumerate(types)])


def to_frame(spark: SparkSession, facts: Iterable[Fact], types: Sequence[str]) -> DataFrame:
    """The distinct tuples of ground facts of one relation."""
    rows = sorted({tuple(a.value for a in f.args) for f in facts})
    return spark.createDataFrame(rows, schema_of(types))


def _fail(condition: Column, message: Column, value: Column) -> Column:
    """``value``, or an error while the plan runs wherever ``condition`` holds."""
    return F.when(condition, F.raise_error(message)).otherwise(value)


def relation(df: DataFrame, columns: Sequence[str] | None = None, nulls: str = "raise") -> DataFrame:
    """Any DataFrame of string and whole-number columns as a relation: set semantics, no nulls.

    A null cell is an error when the relation is evaluated; with ``nulls="drop"`` rows with one are left out.
    """
    if nulls not in ("raise", "drop"):
        raise ValueError(f"nulls must be 'raise' or 'drop', not {nulls!r}")
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    out = []
    for i, c in enumerate(columns):
        if kinds[c] not in ("string", "bigint", "int", "smallint", "tinyint"):
            raise TypeError(f"column {c!r} is {kinds[c]}; cast it to string or bigint first")
        cell = F.col(c).cast("string" if kinds[c] == "string" else "long")
        if nulls == "raise" and df.schema[c].nullable:
            cell = _fail(F.col(c).isNull(), F.lit(f"column {c!r} has a null cell"), cell)
        out.append(cell.alias(f"v{i}"))
    found = df.select(*out)
    return (found.dropna() if nulls == "drop" else found).distinct()


def is_reserved(cell: Column, kind: str) -> Column:
    """Whether a cell of ground data is one of the values that stand for unknown ones."""
    if kind == NUM:
        return cell < LOWEST + 1 + POOL
    bad = F.lit(False)
    for p in RESERVED:
        bad = bad | cell.startswith(p)
    return bad


def guarded(df: DataFrame) -> DataFrame:
    """``df``, which fails when it is evaluated if a cell holds a reserved value; other columns than v0, v1, ... stay."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name.startswith("v") and name[1:].isdigit():
            c = _fail(is_reserved(c, SYM if kind == "string" else NUM), F.concat(F.lit("in conflict with a reserved keyword: "), c.cast("string")), c)
        out.append(c.alias(name))
    return df.select(*out)


def escaped(cell: Column) -> Column:
    """A cell in which tabs, line ends and backslashes are written as ``\\t``, ``\\n``, ``\\r`` and ``\\\\``."""
    for raw, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        cell = F.replace(cell, F.lit(raw), F.lit(mark))
    return cell


def unescaped(cell: Column) -> Column:
    """What ``escaped`` made of a cell, undone; other uses of the backslash stay."""

    def marks(part: Column) -> Column:
        for mark, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            part = F.replace(part, F.lit(mark), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(cell, r"\\\\", -1), marks), "\\")


def types_of(df: DataFrame) -> tuple[str, ...]:
    return tuple(SYM if t == "string" else NUM for _, t in df.dtypes)


def _files(spark: SparkSession, directory: str) -> dict[str, list[str]]:
    """Relation name -> its .facts files, then its .csv files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    names = sorted((s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(path))
    for ending in (".facts", ".csv"):
        for name, full in names:
            if name.endswith(ending):
                found.setdefault(name.removesuffix(ending), []).append(full)
    return found


def load_relations(spark: SparkSession, directory: str, declarations: Mapping[str, Sequence[str]], names: Iterable[str] | None = None, guard: bool = True, escapes: bool = True) -> dict[str, DataFrame]:
    """The relations in a directory of tab-separated files, ``<relation>.facts`` or ``.csv``.

    Fails on undeclared relations, rows with too many or too few columns and cells that aren't of their
    column's type; with ``guard`` also on reserved values.  Bad rows surface when the relation is first evaluated.
    Empty lines are left out, but for relations of one text column, where they are the empty text.  With
    ``escapes``, ``\\t``, ``\\n``, ``\\r`` and ``\\\\`` stand for a tab, line ends and a backslash, as ``write_relations``
    writes them; switch it off for files whose backslashes are plain.
    """
    wanted = None if names is None else set(names)
    out = {}
    for name, paths in _files(spark, directory).items():
        if wanted is not None and name not in wanted:
            continue
        if name not in declarations:
            raise ValueError(f"the relation {name!r} is not declared")
        types = declarations[name]
        lines = spark.read.text(paths)
        raw = (lines if tuple(types) == (SYM,) else lines.where("value != ''")).select(F.split("value", "\t", -1).alias("cells"))
        size = F.size("cells")
        cells = F.when(size == len(types), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit(f"{name} has {len(types)} columns, a row has "), size.cast("string"))))
        row = raw.select(cells.alias("cells"))
        out_cols = []
        for i, t in enumerate(types):
            cell = F.get("cells", F.lit(i))
            if column_type(t) == T.LongType():
                number = cell.try_cast("long")
                value = F.coalesce(number, F.raise_error(F.concat(F.lit(f"{name}, column {i}: not a whole number: "), cell)).cast("long"))
            else:
                value = unescaped(cell) if escapes else cell
            if guard:
                value = _fail(is_reserved(value, t), F.concat(F.lit(f"{name}, column {i}: in conflict with a reserved keyword: "), cell), value)
            out_cols.append(value.alias(f"v{i}"))
        out[name] = row.select(*out_cols).distinct()
    return out


def load_facts(spark: SparkSession, directory: str, declarations: Mapping[str, Sequence[str]], inputs: Iterable[str] | None = None) -> set[Fact]:
    """The facts of a directory as objects, for programs small enough to edit by hand."""
    return {f for name, df in load_relations(spark, directory, declarations, inputs).items() for f in from_frame(df, name)}


def from_frame(df: DataFrame, name: str) -> list[Fact]:
    kinds = types_of(df)
    return [Fact(Literal(name, tuple((String if t == SYM else Number)(v) for t, v in zip(kinds, row, strict=True)))) for row in df.collect()]


def write_relations(directory: str, relations: Mapping[str, DataFrame]) -> None:
    """One folder ``<relation>.facts`` of tab-separated files for each relation; see ``escaped``.  A null cell is an error."""
    for name, df in relations.items():
        cells = [F.coalesce(escaped(F.col(c)) if t == "string" else F.col(c).cast("string"), F.raise_error(F.lit(f"{name}, column {i}: a null cell")).cast("string")) for i, (c, t) in enumerate(df.dtypes)]
        df.select(F.concat_ws("\t", *cells).alias("value")).write.text(f"{directory}/{name}.facts")


def write_facts(spark: SparkSession, directory: str, facts: Iterable[Fact]) -> None:
    groups: dict[str, list[Fact]] = {}
    for f in sorted(facts, key=str):
        groups.setdefault(f.name, []).append(f)
    write_relations(directory, {name: to_frame(spark, fs, [SYM if isinstance(a, String) else NUM for a in fs[0].args]) for name, fs in groups.items()})


def fact_text(name: str, types: Sequence[str], columns: Sequence[str]):
    """A column with the printed fact of each row."""
    parts = []
    for c, t in zip(columns, types, strict=True):
        parts.append(F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) if t == SYM else F.col(c).cast("string"))
    return F.concat(F.lit(f"{name}("), F.concat_ws(", ", *parts), F.lit(")."))
