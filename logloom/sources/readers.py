"""Sources: log files, label files, ground truth, tool output and run configuration."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, exclude: str | None = None) -> DataFrame:
    """``file, line_id, raw``: lines numbered from 0 in the order of each file; a final empty line is no line.

    Large files are read in splits: a line's number is its place in the split
    plus the lines of all earlier splits of the file.
    """
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    if exclude:
        rows = rows.where(~F.col("file").endswith(exclude))
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(offsets, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).cast("int").alias("line_id"), "raw")


def split_lines(table: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The lines of a text column with their places."""
    return table.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_id", "raw"))


def labels(lines: DataFrame, raw: str = "raw", as_int: bool = False) -> DataFrame:
    """Label of each line: what stands before the first ``;``."""
    label = F.split(F.col(raw), ";").getItem(0)
    return lines.select("line_id", (F.try_to_number(label, F.lit("999999999")).cast("int") if as_int else label).alias("label"))


def ground_truth(texts: DataFrame, json: str) -> DataFrame:
    """Entries of JSON objects whose keys are numbers: ``key, value``."""
    return texts.select("line_id", F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))


def json_truth(texts: DataFrame, json: str) -> DataFrame:
    """``line_id, label`` from JSON objects that map line numbers to labels; keys that are no whole number are left out."""
    entries = ground_truth(texts, json)
    return entries.select(F.col("key").try_cast("long").alias("line_id"), F.col("value").alias("label")).where("line_id is not null")


def tool_output(lines: DataFrame, order: str = "line_id", raw: str = "raw") -> DataFrame:
    """Templates and their supports from blocks that end in ``Support: n``."""
    ends = F.col(raw).startswith("Support:")
    block = F.coalesce(F.sum(ends.cast("int")).over(Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("block", block)
    return numbered.groupBy("file", "block").agg(
        F.max(F.when(~ends & (F.col(raw) != ""), F.col(raw))).alias("template"), F.max(F.when(ends, F.regexp_extract(raw, r"Support:\s*(\d+)", 1).cast("long"))).alias("support")
    )


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, cluster_id, other, distance`` from the CSV files that ``sinks.save_distances`` writes."""
    return spark.read.schema("node_id long, cluster_id long, other long, distance double").csv(path, header=True)


def read_config(path: str) -> dict[str, dict[str, str | list[str]]]:
    """Sections of an INI file; options over several lines become lists."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read(path)
    return {s: {k: [x.strip() for x in v.split("\n") if x.strip()] if "\n" in v else v for k, v in parser.items(s)} for s in parser.sections()}
