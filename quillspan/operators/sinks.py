"""Sinks: JSON and CSV results, with Spark's commit protocol in place of replace-on-write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.json_io import verify_manifest
from .corroboration import flat


def finite(df: DataFrame) -> DataFrame:
    """``df``, failing on the first NaN or infinity it would write."""
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            c = F.col(f"`{f.name}`")
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            df = df.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(c))
    return df


def write_json(df: DataFrame, path: str, overwrite: bool = True) -> None:
    finite(df).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_evaluation(folder: str, passages: DataFrame, pages: DataFrame, summary: DataFrame, ranking: DataFrame) -> None:
    """All passages, and apart the uncertain and the flagged, as CSV; pages, summary and ranking as JSON. Empty tables keep their header."""
    rows = flat(passages).persist()
    write_csv(rows, f"{folder}/passages")
    write_csv(rows.where("status = 'uncertain'"), f"{folder}/uncertain")
    write_csv(rows.where("flags <> ''"), f"{folder}/flagged")
    write_csv(ranking, f"{folder}/comparison")
    for name, df in (("pages", pages), ("summary", summary), ("ranking", ranking)):
        write_json(df, f"{folder}/{name}")
    rows.unpersist()


def write_draft(df: DataFrame, path: str) -> None:
    """An annotation draft is never written over."""
    write_json(df, path, overwrite=False)


def replace_json(df: DataFrame, path: str) -> None:
    """Written beside ``path``, then renamed into its place: a reader finds the old table or the new one, or for an instant none, but never a part.

    If the last step fails the old table is put back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    at = spark._jvm.org.apache.hadoop.fs.Path
    target, made, old = at(path), at(f"{path}.new-{mark}"), at(f"{path}.old-{mark}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    write_json(df, made.toString(), overwrite=False)
    before = files.exists(target)
    if before and not files.rename(target, old):
        raise OSError(f"{path} can't be replaced")
    if not files.rename(made, target):
        if before:
            files.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    if before:
        files.delete(old, True)


def keep_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest (path, sha256) of a run, written once; a later one that differs is refused."""
    spark = manifest.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        write_json(manifest, path, overwrite=False)
    elif changed := verify_manifest(spark.read.schema("path string, sha256 string").json(path), manifest).take(5):
        raise ValueError(f"the run's manifest has changed: {[tuple(r) for r in changed]}")


def reference_draft(sources: DataFrame, fields: list[str]) -> DataFrame:
    """(path, sha256, field, status, value): an unannotated slot for each field of each source."""
    slots = F.explode(F.array(*map(F.lit, fields))).alias("field")
    return sources.select("path", "sha256", slots, F.lit("unannotated").alias("status"), F.lit(None).cast("string").alias("value"))


def numbered_lines(df: DataFrame, order: list[str], line: Column, head: list[str], tail: list[str]) -> DataFrame:
    """(place, line): ``head``, a line for each row, ``tail``. A report's table is of methods or fields, so one window holds it."""
    fixed = lambda lines, first: [(first + i, x) for i, x in enumerate(lines)]
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + len(head)).cast("long").alias("place"), line.alias("line"))
    ends = df.sparkSession.createDataFrame(fixed(head, 1) + fixed(tail, (1 << 62)), "place long, line string")
    return rows.union(ends)


def markdown_report(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(place, line) of a Markdown report with one table. Bars in cells are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    row = lambda xs: "| " + " | ".join(xs) + " |"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return numbered_lines(df, order, line, [f"# {title}", "", row(df.columns), row(["---"] * len(df.columns))], [])


def html_report(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(place, line) of an HTML page with one table. Cells are escaped."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    names = "".join(f"<th>{c}</th>" for c in df.columns)
    line = F.concat(F.lit("<tr>"), *[cell(c) for c in df.columns], F.lit("</tr>"))
    return numbered_lines(df, order, line, [f'<!doctype html><meta charset="utf-8"><title>{title}</title>', f"<table><tr>{names}</tr>"], ["</table>"])


def write_report(lines: DataFrame, path: str) -> None:
    """One text file."""
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)
