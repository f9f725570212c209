"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, stored
from quarry.llm import bpe, fingerprint, media, ngram_join, packing, shard, substring, token_counts, tokenfile, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A file of the installed package of public vocabularies."""
    import public_tokenizers

    return os.environ.get("QUARRY_TOKENIZER") or public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests."""
    ids = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path()).drop("text")
    return bpe.decode(ids, tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after windows of 13 words that start in earlier documents are removed."""
    done = substring.dedup(spark, documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (win) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hits)),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
marked AS (SELECT f.doc_id, f.p, f.word, g.p IS NOT NULL AS cut FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p)
SELECT d.doc_id, count(m.p) AS n_words, count(m.p) FILTER (m.cut) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (NOT m.cut), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document."""
    return fingerprint.compare_edited(spark, documents(spark, sf_dir, "doc_id", "text"))


#: The chain's categories in its order: texts marked as of low quality, then toxic ones.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities along the chain, and whether it is toxic."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return toxicity.score(docs, model).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, each closed by id 1, as read back."""
    manifest = tokenfile.write(spark, documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(), 1, tokenfile.folder(spark))
    return tokenfile.read(spark, manifest, with_ids=False).withColumnRenamed("key", "doc_id")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return ngram_join.join(spark, documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * s >= 80 * (p.n + q.n - s)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as media of shared chunks, compacted, read back, verified and described."""
    folder = media.folder(spark)
    rows, places = media.write(spark, documents(spark, sf_dir, "doc_id", "text"), folder)
    places = media.compact(spark, rows, places, folder)
    return media.read(spark, rows, places, folder, described=True).withColumnRenamed("key", "doc_id")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return shard.assign(spark, documents(spark, sf_dir, "doc_id", "text"), 8)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 length buckets of least padding and batches of at most 65,536 padded words."""
    return packing.pack(spark, documents(spark, sf_dir, "doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text before and after three edits, from kept trees, with the leaves that were encoded again."""
    kept = token_counts.trees(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
    kept = stored(spark, kept, f"{shared_dir(spark, 'trees')}/kept").withColumn("edits", token_counts.trial_edits("text"))
    return token_counts.edited_counts(kept, tokenizer_path(), tree="tree", last=True).select("doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_encoded", F.sha2("edited", 256).alias("edited_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_ngram_join": op6_ngram_join,
    "op7_media_chunks": op7_media_chunks,
    "op8_shards": op8_shards,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op6_ngram_join": OP6_SQL}
