"""Tables in saved HTML pages: rows and cells by tag, columns by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions import text


def rows_of(pages: DataFrame, html: str, row: str, cell: str, key: list[str]) -> DataFrame:
    """(key, row_no, column, value) of each cell: its column is the class `cdk-column-<column>`, its value
    the title attribute if it has one, else its text."""
    rows = pages.select(*key, F.posexplode(F.regexp_extract_all(html, F.lit(rf"(?s)<{row}\b[^>]*>(.*?)</{row}>"), F.lit(1))).alias("row_no", "row"))
    cells = rows.select(*key, "row_no", F.explode(F.regexp_extract_all("row", F.lit(rf"(?s)(<{cell}\b[^>]*>.*?</{cell}>)"), F.lit(1))).alias("cell"))
    column = F.regexp_extract("cell", r"cdk-column-([A-Za-z0-9_]+)", 1)
    return cells.select(*key, "row_no", column.alias("column"), cell_value(F.col("cell")).alias("value"))


def cell_value(cell: Column) -> Column:
    title = text.cell_text(F.regexp_extract(cell, r'title="([^"]*)"', 1))
    return F.coalesce(F.nullif(title, F.lit("")), text.cell_text(cell))


def wide(cells: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per row of a table; several cells of a column are joined, each value once."""
    lists = {c: F.transform(F.array_sort(F.collect_set(F.when(F.col("column") == c, F.col("value")))), lambda v: v) for c in columns}
    return cells.groupBy(*key, "row_no").agg(*[text.ordered_unique(v).alias(c) for c, v in lists.items()])
