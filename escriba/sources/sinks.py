"""Writing results: reports, tables, one text per page, and only what is not there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escriba.operators.quality import not_done
from escriba.sources.readers import exists


def json_report(rows: DataFrame, path: str) -> None:
    """K1: rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def texts_by_model(rows: DataFrame, path: str) -> None:
    """K2: texts as Parquet, a folder per model."""
    rows.write.mode("overwrite").partitionBy("model").parquet(path)


def resume(rows: DataFrame, path: str, keys: list[str]) -> int:
    """K8, K9: append the rows whose keys the output lacks; returns how many rows came in."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = not_done(rows, spark.read.parquet(path), keys)
    rows = rows.persist()
    try:
        added = rows.count()
        if added:
            rows.write.mode("append").parquet(path)
    finally:
        rows.unpersist()
    return added


def _cells(summary: DataFrame, columns: list[str], escape: bool) -> list[Column]:
    kinds = dict(summary.dtypes)
    out = []
    for c in columns:
        text = F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.4f", c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("-"))
        out.append(F.replace(text, F.lit("_"), F.lit(r"\_")) if escape else text)
    return out


def markdown_rows(summary: DataFrame, columns: list[str], order: str = "rank") -> DataFrame:
    """K3: a table in Markdown, one row of text per line, in order; numbers with four places."""
    head = [(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))]
    top = summary.sparkSession.createDataFrame(head, "line int, text string")
    body = summary.select(F.col(order).cast("int").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(summary, columns, False)), F.lit(" |")).alias("text"))
    return top.unionByName(body).orderBy("line")


def latex_rows(summary: DataFrame, columns: list[str], order: str = "rank") -> DataFrame:
    """K3: the rows of a table in LaTeX, underscores escaped."""
    text = F.concat(F.concat_ws(" & ", *_cells(summary, columns, True)), F.lit(r" \\"))
    return summary.select(F.col(order).cast("int").alias("line"), text.alias("text")).orderBy("line")


def report_lines(report: DataFrame) -> DataFrame:
    """K4: a corpus report in Markdown, one row per line, a table for each section."""
    order = {name: i for i, name in enumerate(("totals", "markers", "spellings", "abbreviations"))}
    head = [(i, line, text) for name, i in order.items() for line, text in ((-3, f"## {name.capitalize()}"), (-2, "| item | n | detail |"), (-1, "|---|---|---|"))]
    part = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("section"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "item", F.col("n").cast("string"), F.coalesce("detail", F.lit(""))), F.lit(" |"))
    body = report.select(part.alias("part"), F.col("place").cast("int").alias("line"), cells.alias("text"))
    return report.sparkSession.createDataFrame(head, "part int, line int, text string").unionByName(body).orderBy("part", "line")


def split_files(split: DataFrame, path: str) -> None:
    """K7: documents of a split as JSON lines, a folder per side."""
    split.write.mode("overwrite").partitionBy("split").json(path)
