"""Queries that write files with the sinks and read them with the readers, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import cf, minhash, profiles, stats
from quarry.plans import adapters as on
from quarry.plans import catalog as c
from quarry.sources import readers, writers
from quarry.sources.shared import kept, shared_dir

#: Files that the points are dealt to.
CHUNKS = 3


def _review_file(spark: SparkSession, sf_dir: str) -> str:
    """Reviews as JSON lines with dates as text."""
    path = shared_dir(spark, "reviews")
    text = lambda name: F.col(name).cast("string")
    writers.json_lines(on.reviews(spark, sf_dir).select(text("user_id").alias("user_id"), text("item_id").alias("business_id"), "stars", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date")), path)
    return path


def review_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.reviews(spark, _review_file(spark, sf_dir)).select("user_id", "business_id", "stars", F.date_format("date", "yyyy-MM-dd").alias("day"))


def review_file_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_in_year(readers.reviews(spark, _review_file(spark, sf_dir)), c.YEAR)


def business_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a byte order mark, and some that are no objects."""
    path = shared_dir(spark, "businesses")
    rows = on.businesses(spark, sf_dir).select(F.concat(F.lit("\ufeff"), F.to_json(F.struct(F.col("item_id").cast("string").alias("business_id"), "categories"))).alias("value"))
    rows.unionAll(spark.createDataFrame([("no object",), ("",)], "value string")).write.text(path)
    return readers.businesses(spark, path).select("business_id", "categories")


def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    writers.csv_table(c.QUERIES["state_user_item"](spark, sf_dir).withColumnsRenamed({"supplier_id": "business_id"}), path)
    return readers.csv_rows(spark, path)


def stopword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest words, with the stop words of a file."""
    path = shared_dir(spark, "stopwords")
    on.stopwords(spark).write.text(path)
    return stats.top_words(on.texts(spark, sf_dir), c.TOP, readers.stopwords(spark, path, "", " "))


def point_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of several files, each with the number of its file in the order of the paths."""
    path = shared_dir(spark, "points")
    lines = on.points(spark, sf_dir).select("id", F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.col("vec").cast("array<string>"), ",")).alias("value"))
    lines.repartitionById(CHUNKS, F.pmod("id", F.lit(CHUNKS)).cast("int")).select("value").write.text(path)
    return readers.points(spark, path).select("id", "chunk", F.posexplode("vec").alias("dim", "value"))


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of reviews as one JSON document."""
    path = shared_dir(spark, "report")
    rows = on.reviews(spark, sf_dir).select("user_id", "date", F.lit("").alias("text")).unionAll(on.texts(spark, sf_dir).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("timestamp").alias("date"), "text"))
    writers.json_document(stats.report(rows, on.stopwords(spark, "", " "), c.YEAR, c.TOP, c.TOP), path)
    got = readers.json_lines(spark, path, "A long, B long, C long, D array<struct<user_id:long,n:long>>, E array<string>")
    shown = F.transform("D", lambda x: F.concat_ws(":", F.coalesce(x["user_id"].cast("string"), F.lit("-")), x["n"].cast("string")))
    return got.select("A", "B", "C", F.array_join(shown, " ").alias("D"), F.array_join("E", " ").alias("E"))


def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "model")
    writers.json_lines(cf.item_model(on.ratings(spark, sf_dir)), path)
    return readers.model(spark, path)


def user_model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "model")
    writers.json_lines(cf.user_model(on.ratings(spark, sf_dir)), path)
    return readers.model(spark, path, "user")


def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content model as two tables, and the pairs of a test file matched by it."""
    path = shared_dir(spark, "profiles")
    business = kept(c.QUERIES["business_profile"](spark, sf_dir), "profile")
    reviews = on.texts(spark, sf_dir)
    writers.profiles(profiles.user_profile(reviews, business, "source", "doc_id"), business, path)
    writers.json_lines(reviews.select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("business_id")), f"{path}/test")
    pairs = readers.test_pairs(spark, f"{path}/test").select(F.col("user_id").alias("source"), F.col("business_id").cast("long").alias("doc_id")).distinct()
    return profiles.content_predict(spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/businesses"), "source", "doc_id", pairs=pairs)


def similar_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs in order, as JSON lines; the order is that of the files and their lines."""
    path = shared_dir(spark, "similar")
    members = on.reviews(spark, sf_dir).select("item_id", "user_id")
    writers.json_lines(minhash.similar(members, "item_id", "user_id").orderBy("b1", "b2").coalesce(1), path)
    return readers.json_lines(spark, path, "b1 long, b2 long, sim double").coalesce(1).withColumn("place", F.monotonically_increasing_id())


def round_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round report of BFR as CSV: in each round all points that came are in a set or retained."""
    path = shared_dir(spark, "rounds")
    writers.csv_table(c._bfr(spark, sf_dir).round_report().orderBy("round_id").coalesce(1), path)
    got = spark.read.csv(path, header=True, inferSchema=True)
    points = "nof_point_discard + nof_point_compression + nof_point_retained"
    return got.select(F.col("round_id").cast("long").alias("round_id"), F.expr(points).cast("long").alias("n_points"), F.expr("nof_cluster_discard <= 3 and nof_cluster_compression <= nof_point_compression").alias("sound"))


def cluster_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with their clusters as JSON lines: each point once, in one of three clusters."""
    path = shared_dir(spark, "clusters")
    writers.json_lines(c._bfr(spark, sf_dir).finalise(), path)
    got = readers.json_lines(spark, path, "id long, cluster int")
    return got.select("id", F.col("cluster").between(0, 2).alias("known"))


QUERIES: dict[str, c.Query] = {
    "review_file": review_file,
    "review_file_year": review_file_year,
    "business_file": business_file,
    "csv_file": csv_file,
    "stopword_file": stopword_file,
    "point_files": point_files,
    "report_file": report_file,
    "model_file": model_file,
    "user_model_file": user_model_file,
    "profile_files": profile_files,
    "similar_file": similar_file,
    "bfr_round_file": round_file,
    "bfr_cluster_file": cluster_file,
}

TEXT = lambda name: f"CAST({name} AS VARCHAR)"
TOP_WORDS = c.ORACLE_SQL["top_words"]

ORACLE_SQL: dict[str, str] = {
    "review_file": f"WITH {c.REVIEWS} SELECT {TEXT('user_id')} AS user_id, {TEXT('item_id')} AS business_id, stars, strftime(date, '%Y-%m-%d') AS day FROM reviews",
    "review_file_year": c.ORACLE_SQL["reviews_in_year"],
    "business_file": f"WITH {c.BUSINESS} SELECT {TEXT('item_id')} AS business_id, categories FROM business",
    "csv_file": f"SELECT {TEXT('user_id')} AS user_id, {TEXT('supplier_id')} AS business_id FROM ({c.ORACLE_SQL['state_user_item']})",
    "stopword_file": TOP_WORDS,
    "point_files": f"WITH {c.POINTS} SELECT id, CAST(id % {CHUNKS} AS INTEGER) AS chunk, dim, x AS value FROM points",
    "report_file": f"""WITH {c.REVIEWS}, every AS (SELECT user_id, date FROM reviews UNION ALL SELECT NULL, NULL FROM documents),
users AS (SELECT user_id, count(*) AS n FROM every GROUP BY 1 ORDER BY n DESC, user_id NULLS FIRST LIMIT {c.TOP}), top AS ({TOP_WORDS})
SELECT count(*) AS A, count(*) FILTER (year(date) = {c.YEAR}) AS B, count(DISTINCT user_id) AS C,
  (SELECT string_agg(coalesce({TEXT('user_id')}, '-') || ':' || n, ' ' ORDER BY n DESC, user_id NULLS FIRST) FROM users) AS D, (SELECT string_agg(word, ' ' ORDER BY n DESC, word) FROM top) AS E FROM every""",
    "model_file": f"SELECT {TEXT('b1')} AS b1, {TEXT('b2')} AS b2, sim FROM ({c.ORACLE_SQL['item_cf_model']})",
    "user_model_file": f"SELECT {TEXT('u1')} AS u1, {TEXT('u2')} AS u2, sim FROM ({c.ORACLE_SQL['user_cf_model']})",
    "profile_files": f"SELECT * FROM ({c.ORACLE_SQL['content_predict']}) SEMI JOIN documents USING (source, doc_id)",
    "similar_file": f"SELECT *, row_number() OVER (ORDER BY b1, b2) - 1 AS place FROM ({c.ORACLE_SQL['similar_items']})",
    "bfr_round_file": "SELECT k AS round_id, (SELECT count(*) FROM embeddings WHERE vec_id % 2 < k) AS n_points, true AS sound FROM (SELECT unnest([1, 2])::BIGINT AS k)",
    "bfr_cluster_file": "SELECT vec_id AS id, true AS known FROM embeddings",
}
