"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, only: str | None = None) -> None:
    """One object a line; with `only`, the rows for which that column is true."""
    (df if only is None else df.where(F.col(only))).write.mode("overwrite").json(path)


def per_class_text(df: DataFrame, path: str, label: str, text: str, needed: tuple[str, ...] = ()) -> None:
    """Texts in a folder for each class; rows with a null in a needed column are left out."""
    df.dropna(subset=[label, text, *needed]).select(label, F.col(text).alias("value")).write.mode("overwrite").partitionBy(label).text(path)


def per_row_text(df: DataFrame, path: str, label: str, id_col: str, text: str, needed: tuple[str, ...] = ()) -> None:
    """A file for each row, in a folder for its class and one for its id, so that line breaks stay; rows with a null are left out."""
    rows = df.dropna(subset=[label, id_col, text, *needed]).select(label, id_col, F.col(text).alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\n").partitionBy(label, id_col).text(path)


def one_line_text(df: DataFrame, path: str, text: str, id_col: str | None = None) -> None:
    """A text a line, without its own line breaks and tabs, behind its id if one is named."""
    clean = F.regexp_replace(text, "[\n\r\t]+", " ")
    line = clean if id_col is None else F.concat(F.col(id_col).cast("string"), F.lit("\t"), clean)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def rates(df: DataFrame, changed: str, n: str = "tsr") -> DataFrame:
    """A log of one row: the share of rows that were changed."""
    return df.agg(F.try_divide(F.count_if(F.col(changed)).cast("double"), F.count("*").cast("double")).alias(n))


def first_changed(df: DataFrame, pos: str, changed: str) -> DataFrame:
    return df.where(F.col(changed)).orderBy(pos).limit(1)
