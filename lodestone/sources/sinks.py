"""Sinks: JSON objects, JSON lines, CSV, and the report texts.

Reports are DataFrames of one `value` column with a line number that fixes
their order; `save_text` writes them as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_object(df: DataFrame) -> DataFrame:
    """The single row of df as one JSON document, indented by 4."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)


def predictions_csv(df: DataFrame, path: str, names: tuple[str, ...] = ("user_id", " business_id", " prediction")) -> None:
    """A CSV whose header has these names, blanks included."""
    csv(df.toDF(*names), path)


def json_lines(df: DataFrame, path: str, as_text: tuple[str, ...] = ("stars",)) -> None:
    """Rows as JSON lines, some numbers as strings."""
    df.select(*(F.col(c).cast("string").alias(c) if c in as_text else F.col(c) for c in df.columns)).write.mode("overwrite").json(path)


def quoted(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'")))


def itemset_report(itemsets: DataFrame, title: str, items: str = "items") -> DataFrame:
    """(line, value): the title, then a line of all itemsets for each size, sorted, each followed by an empty line."""
    named = itemsets.select(F.size(items).alias("size"), F.concat(F.lit("("), F.array_join(quoted(F.col(items)), ", "), F.lit(")")).alias("s"))
    lines = named.groupBy("size").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("value"))
    head = itemsets.sparkSession.createDataFrame([(0, f"{title}:")], "line int, value string")
    return head.unionByName(lines.select((2 * F.col("size") - 1).alias("line"), "value")).unionByName(lines.select((2 * F.col("size")).alias("line"), F.lit("").alias("value")))


def community_report(communities: DataFrame, members: str = "members") -> DataFrame:
    """(line, value): 'a', 'b' for each community, smaller ones first, then by their members."""
    line = F.row_number().over(Window.orderBy(F.size(members), F.col(members)))
    return communities.select(line.alias("line"), F.array_join(quoted(F.array_sort(F.col(members))), ", ").alias("value"))


def betweenness_report(edges: DataFrame) -> DataFrame:
    """(line, value): ('a', 'b'), value rounded to 5 places, the highest first."""
    line = F.row_number().over(Window.orderBy(F.col("betweenness").desc(), "src", "dst"))
    return edges.select(line.alias("line"), F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.bround("betweenness", 5).cast("string")).alias("value"))


def cluster_report(rounds: DataFrame, assignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of round statistics, and (index, cluster) in index order with -1 for points of no cluster."""
    stats = rounds.select(F.col("round").alias("line"), F.format_string("Round %d: %d,%d,%d,%d", "round", "ds_points", "cs_clusters", "cs_points", "rs_points").alias("value"))
    return stats, assignment.select(F.col("id").alias("index"), F.coalesce("cluster", F.lit(-1)).alias("cluster")).orderBy("index")


def save_text(report: DataFrame, path: str) -> None:
    """The lines of a report in order, as one text file."""
    report.orderBy("line").select("value").coalesce(1).write.mode("overwrite").text(path)
