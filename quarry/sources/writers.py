"""Sinks: one JSON document, JSON lines, CSV, the item set report, profiles and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One object per row; an earlier result is replaced, so a second run does not append."""
    df.write.mode("overwrite").json(path)


def json_document(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON object."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def itemset_line(items: str = "items") -> F.Column:
    """('a') for a single item, ('a', 'b') for more."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit(")"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The lines of the report: for candidates and frequent sets a title and one line for each size, sets in order; columns section, size, line."""
    titles = {"candidates": "Candidates:", "frequent": "Frequent Itemsets:"}
    out = None
    for k, (name, df) in enumerate((("candidates", candidates), ("frequent", frequent))):
        sets = df.select("items", F.size("items").alias("size"))
        lines = sets.groupBy("size").agg(F.array_sort(F.collect_list("items")).alias("sets")).select(F.lit(k).alias("section"), "size", F.array_join(F.transform("sets", lambda s: itemset_line(s)), ",").alias("line"))
        title = df.sparkSession.createDataFrame([(k, 0, titles[name])], "section int, size int, line string")
        out = title.unionAll(lines) if out is None else out.unionAll(title).unionAll(lines)
    return out


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    itemset_report(candidates, frequent).orderBy("section", "size").select("line").coalesce(1).write.mode("overwrite").text(path)


def profiles(users: DataFrame, businesses: DataFrame, path: str) -> None:
    """A content model as two tables."""
    users.write.mode("overwrite").parquet(f"{path}/users")
    businesses.write.mode("overwrite").parquet(f"{path}/businesses")
