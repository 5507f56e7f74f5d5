"""Reading the loan file and writing scored loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbook.functions.text import quoted
from riskbook.schema import (
    KEY_COLUMNS,
    NUMERIC_COLUMNS,
    PERCENT_COLUMNS,
    TEXT_COLUMNS,
)
from riskbook.sources.types import infer_types, typed


def _text(name: str) -> Column:
    # The CSV reader gives NULL for blank text; there it is a value, and the
    # literal NA is the missing one.
    return F.nullif(F.coalesce(F.col(quoted(name)), F.lit("")), F.lit("NA"))


def _raw(spark: SparkSession, path: str | list[str], multi_line: bool, names: list[str] | None) -> tuple[DataFrame, str]:
    """All columns as text, and the name of one more that has the line of a malformed row."""
    options = {"header": names is None, "quote": '"', "escape": '"', "multiLine": multi_line}
    names = names or spark.read.csv(path, **options).columns
    malformed = "malformed_line"
    while malformed in names:
        malformed += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, malformed]])
    return spark.read.csv(path, schema=schema, columnNameOfCorruptRecord=malformed, **options), malformed


def malformed_lines(
    spark: SparkSession, path: str | list[str], *, multi_line: bool = False, names: list[str] | None = None
) -> DataFrame:
    """(line): the rows with another number of fields than the header, as they stand in the file."""
    raw, line = _raw(spark, path, multi_line, names)
    nothing = _all_fields(raw, line)
    return raw.filter(F.col(line).isNotNull()).select(F.concat(line, nothing).alias("line"))


def _all_fields(raw: DataFrame, line: str) -> Column:
    """Empty text that hangs on every field: the reader counts only the fields that are asked for."""
    return F.left(F.concat_ws("", *[F.col(quoted(c)) for c in raw.columns if c != line]), F.lit(0))


def read_loans(
    spark: SparkSession,
    path: str | list[str],
    *,
    multi_line: bool = False,
    infer_unknown: bool = True,
    names: list[str] | None = None,
    drop_malformed: bool = False,
) -> DataFrame:
    """Typed loan table from CSV files with a header, or without one and with `names`.

    Known columns are typed by name; the types of all others are inferred with
    one pass over just those. Files are split between tasks. Quoted text with
    line breaks in it needs multi_line=True, which reads each file whole.
    A row with too few fields is filled up with missing ones and the surplus of
    one with too many is cut, unless malformed rows are dropped;
    `malformed_lines` lists them.
    """
    if drop_malformed:
        raw, line = _raw(spark, path, multi_line, names)
        raw = raw.filter(F.col(line).isNull() & (_all_fields(raw, line) == "")).drop(line)
    elif names:
        raw, line = _raw(spark, path, multi_line, names)
        raw = raw.drop(line)
    else:
        raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    text = set(TEXT_COLUMNS) | set(PERCENT_COLUMNS)
    kinds = {c: "text" for c in raw.columns}
    kinds |= {c: "double" for c in NUMERIC_COLUMNS} | {c: "integer" for c in KEY_COLUMNS}
    unknown = [c for c in raw.columns if c not in text | set(NUMERIC_COLUMNS) | set(KEY_COLUMNS)]
    if infer_unknown and unknown:
        kinds |= {r["column"]: r["type"] for r in infer_types(raw, unknown).collect()}
    return raw.select(*[(_text(c) if kinds[c] == "text" else typed(c, kinds[c])).alias(c) for c in raw.columns])


def write_scored(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write scored loans as Parquet."""
    scored.write.mode(mode).parquet(path)
