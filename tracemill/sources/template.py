"""Workbooks that have to follow a template: records of the sheets it names, and an error for each sheet or column that is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: what is said of a missing sheet or column.
NO_SHEET, NO_COLUMN = "Required sheet is missing.", "Required column is missing."


def header_name(header: Column) -> Column:
    """Lower case, one underscore for what is no letter or digit, none at either end."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(header, F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_|_$", "")


def template_scan(files: DataFrame, cells: DataFrame, template: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of workbooks.

    files: file. cells: file, sheet, row_number, cells (array), rows in the sheets' own numbers; the first row of a sheet is its header. records: file, sheet, row_number, values (map) of the
    sheets in the template, whether their columns are complete or not; of columns with one name the last stands, and missing cells are empty. errors: file, sheet, column, reason. A file without
    any rows misses every sheet; a sheet with a header only has no records.
    """
    spark = cells.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s, c) for s, c in template.items()], "sheet string, columns array<string>"))  # a template's own size
    inside = cells.join(wanted.select("sheet"), "sheet", "left_semi")
    # records get their header within one pass over the cells, sheet by sheet, as cells may be dear to read
    header = F.first(F.struct("row_number", F.transform("cells", header_name).alias("headers"))).over(Window.partitionBy("file", "sheet").orderBy(F.asc_nulls_last("row_number")))
    rows = inside.withColumn("_h", header).filter(F.col("row_number") > F.col("_h.row_number")).withColumn("headers", F.col("_h.headers"))
    value = F.transform("headers", lambda h, i: F.struct(h.alias("h"), F.trim(F.coalesce(F.get("cells", i), F.lit(""))).alias("v"), i.alias("i")))
    last = F.filter(value, lambda x: ~F.exists(value, lambda y: (y["h"] == x["h"]) & (y["i"] > x["i"])))
    records = rows.select("file", "sheet", "row_number", F.map_from_entries(F.transform(last, lambda x: F.struct(x["h"], x["v"]))).alias("values"))

    first = inside.groupBy("file", "sheet").agg(F.min_by(F.struct("row_number", "cells"), "row_number").alias("h"))
    heads = first.select("file", "sheet", F.transform("h.cells", header_name).alias("headers"))
    due = files.select("file").distinct().crossJoin(wanted).join(heads, ["file", "sheet"], "left")  # each file by the few sheets of the template
    gone = F.when(F.col("headers").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(NO_SHEET).alias("reason"))))
    lacking = F.transform(F.array_except("columns", F.coalesce("headers", F.array().cast("array<string>"))), lambda c: F.struct(c.alias("column"), F.lit(NO_COLUMN).alias("reason")))
    errors = due.select("file", "sheet", F.inline(F.coalesce(gone, lacking)))
    return records, errors
