"""Readers: JSON lines, CSV, stop words, models and files of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import schemas


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; a byte order mark at the start of a file is skipped, lines that are no objects are dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.trim("value").startswith("{").alias("_ok"))
    return parsed.where("_ok and r is not null").select("r.*")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews, with ``date`` as a timestamp (null where it cannot be read)."""
    return json_lines(spark, path, schemas.REVIEW).withColumn("date", F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss")))


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.BUSINESS)


def test_pairs(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.TEST_PAIR)


def model(spark: SparkSession, path: str, kind: str = "item") -> DataFrame:
    """A similarity model of items (b1, b2, sim) or users (u1, u2, sim)."""
    return json_lines(spark, path, schemas.ITEM_MODEL if kind == "item" else schemas.USER_MODEL)


def csv_rows(spark: SparkSession, path: str, schema: str = schemas.USER_BUSINESS) -> DataFrame:
    """CSV with a header in each file."""
    return spark.read.schema(schema).csv(path, header=True)


def stopwords(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """One word per line, and further words; a column ``word``."""
    words = spark.read.text(path).select(F.col("value").alias("word"))
    return words.unionAll(spark.createDataFrame([(w,) for w in extra], "word string")).distinct() if extra else words.distinct()


def points(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id,x1,...,xd`` of ``*.txt`` files: id, vec and chunk, the number of the file in the order of the paths, from 0 on."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parts = F.split("value", ",")
    rows = lines.where(F.length(F.trim("value")) > 0).select(parts[0].cast("long").alias("id"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("vec"), "file")
    files = rows.select("file").distinct().withColumn("chunk", F.row_number().over(Window.orderBy("file")) - 1)  # a row for each file
    return rows.join(files, "file").select("id", "vec", "chunk")


def point_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a stream, one file a batch in the order in which they came: id, vec."""
    lines = spark.readStream.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", 1).text(path)
    parts = F.split("value", ",")
    return lines.where(F.length(F.trim("value")) > 0).select(parts[0].cast("long").alias("id"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("vec"))
