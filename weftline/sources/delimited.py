"""Loosely typed delimited text: the dialect from a sample, types from all rows."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 50
DELIMITERS = ",;\t| "


@dataclass(frozen=True)
class Dialect:
    sep: str
    names: tuple[str, ...]
    header: bool


def sniffed(lines: list[str], header: bool | None = True) -> Dialect:
    """The dialect from the first lines: comment lines go, blanks around names and one empty name at the end too.

    ``header`` None takes a first line without numbers as header.
    """
    body = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    if not body:
        raise ValueError("no line to read")
    try:
        sep = csv.Sniffer().sniff(body[0], DELIMITERS).delimiter
    except csv.Error:
        sep = ","  # a single column
    first = [x.strip() for x in next(csv.reader([body[0]], delimiter=sep, skipinitialspace=True))]
    if header is None:
        header = not any(_number(x) for x in first)
    names = first if header else [f"c{i}" for i in range(len(first))]
    if names and names[-1] == "":
        names = names[:-1]
    if len(set(names)) < len(names):
        seen: dict[str, int] = {}
        names = [n if (seen.__setitem__(n, seen.get(n, 0) + 1) or seen[n] == 1) else f"{n}_{seen[n]}" for n in names]
    return Dialect(sep, tuple(names), header)


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def _kinds(texts: DataFrame) -> dict[str, str]:
    """``bigint`` where all values are whole, ``double`` where all are numbers, else ``string``."""
    fails = lambda c, kind: F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS {kind})").isNull())
    asked = [a for c in texts.columns for a in (fails(c, "bigint").alias(f"{c}\x00i"), fails(c, "double").alias(f"{c}\x00d"))]
    found = texts.agg(*asked, F.count(F.lit(1)).alias("\x00n")).first()
    if not found["\x00n"]:
        return dict.fromkeys(texts.columns, "string")
    return {c: "bigint" if not found[f"{c}\x00i"] else "double" if not found[f"{c}\x00d"] else "string" for c in texts.columns}


def read_delimited(
    spark: SparkSession, path: str | list[str], header: bool | None = True, sep: str | None = None, tag_files: bool = False
) -> DataFrame:
    """Files of one layout as one table. ``tag_files`` adds the column ``file``."""
    lines = [r[0] for r in spark.read.text(path).take(SAMPLE)]
    dialect = sniffed(lines, header)
    schema = ", ".join(f"`{n}` string" for n in dialect.names)
    reader = spark.read.schema(schema).option("sep", sep or dialect.sep).option("comment", "#").option("header", dialect.header)
    texts = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)
    typed: list[Column] = [F.col(f"`{c}`").cast(kind).alias(c) for c, kind in _kinds(texts).items()]
    return texts.select(*typed, *([F.col("_metadata.file_path").alias("file")] if tag_files else []))


def csv_lines(df: DataFrame, sep: str = ", ") -> DataFrame:
    """``line``: each row as text; the names are ``sep.join(df.columns)``. Nulls are written as ``None``."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in df.columns]
    return df.select(F.concat_ws(sep, *texts).alias("line"))


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("sep", sep).option("header", True).csv(path)
