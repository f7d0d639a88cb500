"""Templates (abstractions) of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.strings import common_substring_udf

from .events import positional_template


def substring_templates(rows: DataFrame, cluster: str, order: str, text: str) -> DataFrame:
    """Longest common part of the distinct texts of each cluster; one text alone has none."""
    texts = rows.groupBy(cluster, text).agg(F.min(order).alias(order)).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("texts"))
    return texts.select(cluster, common_substring_udf("texts").alias("template"))


def candidate_groups(rows: DataFrame, cluster: str) -> DataFrame:
    """Cluster and word count, with distinct token lists."""
    return rows.groupBy(cluster, F.size("tokens").alias("n_words")).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct(F.concat_ws(" ", "tokens")).alias("n_texts"))


def asterisk_templates(rows: DataFrame, cluster: str) -> DataFrame:
    """Positional template of each cluster and word count; all ``*`` gives one template for each distinct text."""
    sized = rows.withColumn("n_words", F.size("tokens"))
    made = positional_template(sized, [cluster, "n_words"])
    blank = F.regexp_replace("template", r"[* ]", "") == ""
    own = sized.join(made.where(blank).select(cluster, "n_words"), [cluster, "n_words"], "left_semi").groupBy(cluster, "n_words", F.concat_ws(" ", "tokens").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    return made.where(~blank).select(cluster, "n_words", "template", "n").unionByName(own.select(cluster, "n_words", "template", "n"))


def contained_templates(templates: DataFrame) -> DataFrame:
    """Pairs of a template and the first longer one that contains it (templates are few against lines)."""
    short, long_ = templates.select(F.col("template").alias("short")).distinct(), templates.select(F.col("template").alias("long")).distinct()
    pairs = short.join(long_, F.col("long").contains(F.col("short")) & (F.length("long") > F.length("short")) & (F.col("short") != ""))
    return pairs.groupBy("short").agg(F.min(F.struct(F.length("long").alias("n"), "long")).alias("b")).select("short", F.col("b.long").alias("long"))


def trailing_asterisks(template: Column) -> Column:
    """How many ``*`` end a template."""
    return F.length(F.replace(F.regexp_extract(template, r"((?:(?:^| )\*)+)$", 1), F.lit(" "), F.lit("")))


def renumbered(templates: DataFrame) -> DataFrame:
    """Empty templates go, the rest get dense ids in order of text."""
    kept = templates.select("template").where("template <> ''").distinct()
    return kept.withColumn("template_id", (F.row_number().over(Window.orderBy("template")) - 1).cast("long"))


def re_identified(templates: DataFrame, truth: DataFrame) -> DataFrame:
    """Ids of the ground truth by exact text; unknown templates get the next ids in order."""
    known = templates.select("template").distinct().join(truth.select("template", F.col("template_id").alias("known")), "template", "left")
    top = truth.agg(F.coalesce(F.max("template_id"), F.lit(-1)).alias("top"))
    fresh = known.where("known is null").join(F.broadcast(top)).select("template", (F.row_number().over(Window.orderBy("template")) + F.col("top")).cast("long").alias("template_id"))
    return known.where("known is not null").select("template", F.col("known").cast("long").alias("template_id")).unionByName(fresh)
