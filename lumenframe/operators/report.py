"""Reports as text: tables in Markdown, one document per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """A value as a table cell: a dash for null; bars, which would end the cell, are escaped."""
    return F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))


def markdown(rows: DataFrame, name: Column, columns: list[str], order: list[str]) -> DataFrame:
    """name, content: a Markdown table of the rows of each name, in order. Meant for summaries: a document is one row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    lines = rows.select(name.alias("name"), F.struct(*order, line.alias("line")).alias("s")).groupBy("name").agg(F.array_sort(F.collect_list("s")).alias("s"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return lines.select("name", F.concat(F.lit(head), F.array_join(F.transform("s", lambda s: s["line"]), "\n"), F.lit("\n")).alias("content"))
