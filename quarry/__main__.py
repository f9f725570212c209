"""Command line: ``python -m quarry <job> ...``; paths may be of any file system that Spark reads."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import MORE_STOPWORDS
from quarry.operators import baskets, bfr, cf, minhash, profiles, stats
from quarry.sources import readers, writers
from quarry.sources.shared import kept, shared_dir


def review_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.json_document(stats.report(readers.reviews(spark, a.reviews), readers.stopwords(spark, a.stopwords, "", " "), a.year, a.m, a.n), a.output)


def category_averages(spark: SparkSession, a: argparse.Namespace) -> None:
    out = stats.category_averages(readers.reviews(spark, a.reviews), readers.businesses(spark, a.businesses), a.num)
    rows = out.agg(F.array_sort(F.collect_list(F.struct((-F.col("avg_stars")).alias("o"), "category", "avg_stars"))).alias("r"))  # ``num`` rows
    writers.json_document(rows.select(F.transform("r", lambda x: F.struct(x["category"].alias("category"), x["avg_stars"].alias("avg"))).alias("result")), a.output)


def partitions(spark: SparkSession, a: argparse.Namespace) -> None:
    df = readers.reviews(spark, a.reviews)
    if a.kind == "custom":
        df = stats.dealt(df, a.partitions, F.xxhash64("business_id"))
    writers.json_lines(stats.partition_profile(df), f"{a.output}/partitions")
    writers.json_lines(stats.heavy_items(df, a.n), f"{a.output}/result")


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.csv_table(stats.reviews_in_state(readers.reviews(spark, a.reviews), readers.businesses(spark, a.businesses), a.state), a.output)


def item_sets(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.csv_rows(spark, a.input)
    pairs = kept(baskets.baskets(rows, *(("user_id", "business_id") if a.case == 1 else ("business_id", "user_id"))), "pairs")
    found = baskets.son_candidates(pairs, a.support, F.pmod(F.xxhash64("basket"), F.lit(a.parts)))
    writers.write_itemset_report(found, baskets.count_sets(pairs, found).where(F.col("support") >= a.support), a.output)


def similar_businesses(spark: SparkSession, a: argparse.Namespace) -> None:
    df = readers.reviews(spark, a.reviews)
    writers.json_lines(minhash.similar(df, "business_id", "user_id", a.least, wide=True).orderBy("b1", "b2"), a.output)


def content_train(spark: SparkSession, a: argparse.Namespace) -> None:
    df = readers.reviews(spark, a.reviews)
    counts = profiles.word_counts(df, readers.stopwords(spark, a.stopwords, *MORE_STOPWORDS), "business_id")
    business = kept(profiles.business_profile(profiles.tf_idf(profiles.without_rare(counts), "business_id"), "business_id"), "profile")
    writers.profiles(profiles.user_profile(df, business, "user_id", "business_id"), business, a.model)


def content_predict(spark: SparkSession, a: argparse.Namespace) -> None:
    users, items = (spark.read.parquet(f"{a.model}/{n}") for n in ("users", "businesses"))
    writers.json_lines(profiles.content_predict(users, items, "user_id", "business_id", pairs=readers.test_pairs(spark, a.test).distinct()), a.output)


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    return kept(cf.ratings(readers.reviews(spark, path), item="business_id"), "ratings")


def cf_train(spark: SparkSession, a: argparse.Namespace) -> None:
    train = _ratings(spark, a.train)
    if a.kind == "item":
        writers.json_lines(cf.item_model(train), a.model)
        return
    writers.json_lines(cf.user_model(train, wide=True), a.model)


def cf_predict(spark: SparkSession, a: argparse.Namespace) -> None:
    train, test = _ratings(spark, a.train), readers.test_pairs(spark, a.test).withColumnRenamed("business_id", "item_id")
    model = readers.model(spark, a.model, a.kind)
    out = cf.item_predict(train, test, model) if a.kind == "item" else cf.user_predict(train, test, model)
    writers.json_lines(out.withColumnRenamed("item_id", "business_id"), a.output)


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    points = kept(readers.points(spark, a.input), "points")
    run = bfr.BFR(spark, shared_dir(spark, "bfr"), a.k)
    for k in range(points.select("chunk").distinct().count()):
        run.feed(points.where(F.col("chunk") == k))
    writers.csv_table(run.round_report().orderBy("round_id").coalesce(1), f"{a.output}/rounds")
    writers.json_lines(run.finalise(), f"{a.output}/clusters")


JOBS = {
    "review-stats": (review_stats, ["reviews", "output", "stopwords", ("year", int), ("m", int), ("n", int)]),
    "category-averages": (category_averages, ["reviews", "businesses", "output", ("num", int)]),
    "partitions": (partitions, ["reviews", "output", "kind", ("partitions", int), ("n", int)]),
    "preprocess": (preprocess, ["reviews", "businesses", "state", "output"]),
    "item-sets": (item_sets, [("case", int), ("support", int), "input", "output"]),
    "similar-businesses": (similar_businesses, ["reviews", "output"]),
    "content-train": (content_train, ["reviews", "model", "stopwords"]),
    "content-predict": (content_predict, ["model", "test", "output"]),
    "cf-train": (cf_train, ["train", "model", "kind"]),
    "cf-predict": (cf_predict, ["train", "test", "model", "output", "kind"]),
    "bfr": (cluster, ["input", "output", ("k", int)]),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (_, fields) in JOBS.items():
        p = jobs.add_parser(name)
        for f in fields:
            p.add_argument(f if isinstance(f, str) else f[0], type=str if isinstance(f, str) else f[1])
        p.add_argument("--least", type=float, default=0.05)
        p.add_argument("--parts", type=int, default=8)
    a = parser.parse_args(argv)
    start = time.time()
    JOBS[a.job][0](SparkSession.builder.getOrCreate(), a)
    print(f"Duration: {time.time() - start:.2f} s")


if __name__ == "__main__":
    main()
