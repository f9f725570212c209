"""TF-IDF profiles and content-based matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.measures import cosine
from quarry.functions.text import normal_words
from quarry.sources.shared import kept

TOP_WORDS = 200
#: A word must make up so many millionths of all words.
RARE_PER_MILLION = 1
DIGITS = 9
#: Different words that are sent to all tasks, as common words are that each make up a millionth.
WORDS = 1_000_000
#: Words of texts that are counted at once, if they are not one long text.
READ = 1 << 20
#: Words of users that are sent to all tasks at once.
BLOCK = 1_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, words (a list) to key, word, f; some words at once, and never a part of a row."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + READ, side="right")))
            words = pc.list_flatten(batch.column(1).slice(at, to - at)).dictionary_encode()
            size = max(1, len(words.dictionary))
            found, f = np.unique(np.repeat(np.arange(at, to), lengths[at:to]) * size + words.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found // size)), words.dictionary.take(pa.array(found % size)), pa.array(f)], names=[*batch.schema.names[:1], "word", "f"])
            at = to


def word_counts(texts: DataFrame, stopwords: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, f: words of the distinct texts of a key, without stop words and empty ones. The table is stored, as all that follows reads it several times.

    The words of a text are counted before anything moves; they move only where a key has several texts.
    """
    n, keys = texts.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    rows = texts.select(key, text) if n == keys else texts.select(key, text).distinct()
    kind = rows.schema[key].dataType.simpleString()
    words = rows.select(key, normal_words(F.col(text)).alias("words")).mapInArrow(_counted, f"`{key}` {kind}, word string, f long").where("word <> ''")
    left = words.join(F.broadcast(stopwords), "word", "left_anti").select(key, "word", "f")
    return kept(left if n == keys else left.groupBy(key, "word").agg(F.sum("f").alias("f")), "words")


def without_rare(counts: DataFrame, per_million: int = RARE_PER_MILLION) -> DataFrame:
    """Only words that make up their share of all words, with the keys that have them (_df); all words below a million words."""
    totals = kept(counts.groupBy("word").agg(F.sum("f").alias("_f"), F.count(F.lit(1)).alias("_df")), "totals")
    total = totals.agg(F.sum("_f").alias("_t"))
    common = kept(totals.join(F.broadcast(total), F.lit(True)).where(F.col("_f") * 1_000_000 >= F.col("_t") * per_million).select("word", "_df"), "common")
    return counts.join(F.broadcast(common), "word")  # at most a million words, by their share


def tf_idf(counts: DataFrame, key: str) -> DataFrame:
    """key, word, score = f / max f of the key * log2(keys / keys with the word), rounded. Counts move by key once; where the keys with a word (_df) are not known, their numbers go to the counts, up to ``WORDS`` words."""
    if "_df" not in counts.columns:
        df = kept(counts.groupBy("word").agg(F.count(F.lit(1)).alias("_df")), "df")
        counts = counts.join(F.broadcast(df) if df.count() <= WORDS else df, "word")
    n = counts.select(key).distinct().agg(F.count(key).alias("_n"))
    top = counts.withColumn("_max", F.max("f").over(Window.partitionBy(key))).join(F.broadcast(n), F.lit(True))
    return top.select(key, "word", F.round(F.col("f") / F.col("_max") * F.log2(F.col("_n") / F.col("_df")), DIGITS).alias("score"))


def business_profile(scores: DataFrame, key: str, top: int = TOP_WORDS) -> DataFrame:
    """The words with the highest scores of each key, ties by word: key, word."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("word"))
    return scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).select(key, "word")


def user_profile(reviews: DataFrame, profile: DataFrame, user: str, key: str) -> DataFrame:
    """The union of the profiles of what a user reviewed: user, word."""
    return reviews.select(user, key).distinct().join(profile, key).select(user, "word").distinct()


def content_predict(users: DataFrame, items: DataFrame, user: str, key: str, least: float = 0.01, pairs: DataFrame | None = None) -> DataFrame:
    """user, key, sim: cosine of the profiles, where it is at least so much; for given pairs, or all that share a word.

    Words of an item lie together, and go to a table of words with their users
    (in blocks of some users), so words shared are counted before rows move.
    """
    items = kept(items.select(key, "word").repartition(key), "items")
    n1 = kept(users.groupBy(user).agg(F.count(F.lit(1)).alias("_n1")).withColumn("_u", F.monotonically_increasing_id()), "users")
    n2 = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n2"))
    if pairs is not None:  # profiles of items are short: a pair costs their words
        items = pairs.join(n1.select(user, "_u"), user).select("_u", key).join(items, key)
    blocks = -(-int(n1.agg(F.sum("_n1")).first()[0] or 0) // BLOCK)
    held = users.join(n1.select(user, F.col("_u").alias("_by")), user).select("word", "_by")
    shared = None
    for b in range(max(1, blocks)):
        block = held if blocks <= 1 else held.where(F.pmod(F.xxhash64("_by"), F.lit(blocks)) == b)
        words = block.groupBy("word").agg(F.collect_list("_by").alias("_by"))
        met = items.join(F.broadcast(words), "word")
        met = met.withColumn("_u", F.explode("_by")) if pairs is None else met.where(F.array_contains("_by", F.col("_u")))
        counted = met.groupBy(key, "_u").agg(F.count(F.lit(1)).alias("_s"))
        shared = counted if shared is None else shared.unionAll(counted)
    sim = cosine(F.col("_s"), F.col("_n1"), F.col("_n2"))
    return shared.join(n1, "_u").join(n2, key).select(user, key, F.round(sim, DIGITS).alias("sim")).where(F.col("sim") >= least)
