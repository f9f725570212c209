"""Queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import MORE_STOPWORDS
from quarry.operators import baskets as bk
from quarry.operators import bfr, cf, minhash, profiles, stats
from quarry.operators import kmeans as km
from quarry.plans import adapters as on
from quarry.sources import writers
from quarry.sources.shared import kept, shared_dir

YEAR, TOP, HEAVY, PARTS, STATE = 1997, 10, 40, 8, "NATION_3"
#: A set is frequent in one of 220 baskets.
SHARE, SON_PARTS = 220, 4
K = 10
#: Brands that a pair of types must be in, of 25.
MOST_BRANDS = 15
#: Rounds that the SQL of K-Means writes out; at sf0.01 it converges in far fewer, and further rounds change nothing.
SQL_ROUNDS = 40

Query = Callable[[SparkSession, str], DataFrame]


def _baskets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The different baskets of each part, made once, and the support."""
    held = kept(bk.lists(on.baskets(spark, sf_dir).withColumn("part", F.pmod("basket", F.lit(SON_PARTS)).cast("int")), ["part"]), "baskets")
    return held, -(-bk.number(held) // SHARE)


def _shown(sets: DataFrame) -> DataFrame:
    columns = [F.array_join("items", ",").alias("items"), *(["support"] if "support" in sets.columns else [])]
    return sets.select(*columns)


def _level(k: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        held, support = _baskets(spark, sf_dir)
        found = bk.apriori(held, support, k)
        return _shown(found.where(F.size("items") == k))

    return query


def _son_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(bk.son_candidates(*_baskets(spark, sf_dir), F.col("part")))


def _son(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(bk.son(*_baskets(spark, sf_dir), F.col("part")))


def _itemset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, support = _baskets(spark, sf_dir)
    found = bk.son_candidates(held, support, F.col("part"))
    return writers.itemset_report(found, bk.count_sets(held, found).where(F.col("support") >= support))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their users, as often as they reviewed them."""
    return on.reviews(spark, sf_dir).select("item_id", "user_id")


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.signatures(_members(spark, sf_dir), 50, "item_id", "user_id").select("item_id", "hash", F.col("value").cast("long").alias("value"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.candidates(_members(spark, sf_dir), 50, "item_id", "user_id")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.word_counts(on.texts(spark, sf_dir), on.stopwords(spark, *MORE_STOPWORDS), "doc_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.tf_idf(profiles.without_rare(_words(spark, sf_dir)), "doc_id")


def _business_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.business_profile(_scores(spark, sf_dir), "doc_id")


def _user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.user_profile(on.texts(spark, sf_dir), _business_profile(spark, sf_dir), "source", "doc_id")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    business = kept(_business_profile(spark, sf_dir), "profile")
    return profiles.content_predict(profiles.user_profile(on.texts(spark, sf_dir), business, "source", "doc_id"), business, "source", "doc_id")


def _item_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.item_model(on.ratings(spark, sf_dir))


def _user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.user_model(on.ratings(spark, sf_dir))


def _item_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = kept(on.ratings(spark, sf_dir), "ratings")
    return cf.item_predict(train, train, cf.item_model(train))


def _user_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = kept(on.ratings(spark, sf_dir), "ratings")
    return cf.user_predict(train, train, kept(cf.user_model(train), "model"))


def _start(points: DataFrame) -> km.Centres:
    return {i: list(r["vec"]) for i, r in enumerate(points.orderBy("id").limit(K).collect())}


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = on.points(spark, sf_dir).select("id", "vec")
    return km.assign(points, _start(points))


def _cluster_stats(spark: SparkSession, sf_dir: str) -> dict[int, bfr.Stats]:
    return bfr.collected(bfr.cluster_stats(on.points(spark, sf_dir)))


def _mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = on.points(spark, sf_dir).select("id", "vec")
    return bfr.assign_within(points, _cluster_stats(spark, sf_dir)).select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfr.merge_pairs(spark, _cluster_stats(spark, sf_dir))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first centres of K-Means, each the point farthest from those before it."""
    rows = [(c, d, x) for c, v in km.first_centres(on.points(spark, sf_dir), K).items() for d, x in enumerate(v)]
    return spark.createDataFrame(rows, "cluster int, dim int, value double")


def _kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.kmeans(on.points(spark, sf_dir).select("id", "vec"), K).select("id", F.col("cluster").cast("int").alias("cluster"), F.round("distance", 6).alias("distance"))


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the real partitions after dealing by item."""
    return stats.partition_profile(stats.dealt(on.reviews(spark, sf_dir), PARTS, F.col("item_id")))


def _swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part types that most brands have: the item of the other case is the key here."""
    pairs = bk.baskets(on.table(spark, sf_dir, "part"), "p_brand", "p_type")
    return _shown(bk.apriori(pairs, MOST_BRANDS, 2).where("size(items) = 2"))


def _finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = {c: s.mean() for c, s in _cluster_stats(spark, sf_dir).items()}
    return bfr.finalise(on.points(spark, sf_dir).select("id", "vec"), centres)


def _bfr(spark: SparkSession, sf_dir: str) -> bfr.BFR:
    out = bfr.BFR(spark, shared_dir(spark, "bfr"), 3)
    rows = on.points(spark, sf_dir).select("id", "vec")
    for k in range(2):  # all points, in two chunks
        out.feed(rows.where(F.pmod("id", F.lit(2)) == k))
    return out


QUERIES: dict[str, Query] = {
    "reviews_total": lambda s, d: stats.count_reviews(on.reviews(s, d)),
    "reviews_in_year": lambda s, d: stats.count_in_year(on.reviews(s, d), YEAR),
    "distinct_users": lambda s, d: stats.count_users(on.reviews(s, d)),
    "top_users": lambda s, d: stats.top_users(on.reviews(s, d), TOP),
    "top_words": lambda s, d: stats.top_words(on.texts(s, d), TOP, on.stopwords(s, "", " ")),
    "category_avg_stars": lambda s, d: stats.category_averages(on.reviews(s, d), on.businesses(s, d), TOP, "item_id"),
    "heavy_items": lambda s, d: stats.heavy_items(on.reviews(s, d), HEAVY, "item_id"),
    "partition_profile": _partitions,
    "partition_rule": lambda s, d: stats.partition_profile(on.reviews(s, d), PARTS, F.col("item_id")),
    "state_user_item": lambda s, d: stats.reviews_in_state(on.reviews(s, d), on.states(s, d), STATE, "user_id", "supplier_id"),
    "frequent_items_1": _level(1),
    "frequent_items_2": _level(2),
    "frequent_items_3": _level(3),
    "frequent_pairs_swapped": _swapped,
    "son_candidates": _son_candidates,
    "son_frequent": _son,
    "itemset_report": _itemset_report,
    "minhash_signature": _signature,
    "lsh_candidates": _candidates,
    "similar_items": lambda s, d: minhash.similar(_members(s, d), "item_id", "user_id"),
    "similar_items_exact": lambda s, d: minhash.similar(_members(s, d), "item_id", "user_id", n=None),
    "tfidf_scores": _scores,
    "business_profile": _business_profile,
    "user_profile": _user_profile,
    "content_predict": _content,
    "ratings_last": lambda s, d: cf.ratings(on.reviews(s, d), dup="last"),
    "item_cf_model": _item_model,
    "user_cf_model": _user_model,
    "item_cf_predict": _item_predict,
    "user_cf_predict": _user_predict,
    "kmeans_assign_step": lambda s, d: _assigned(s, d).select("id", F.col("cluster").cast("int").alias("cluster")),
    "kmeans_centroid_step": lambda s, d: km.centroids(_assigned(s, d)).select(F.col("cluster").cast("int").alias("cluster"), F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value")),
    "kmeans_objective": lambda s, d: km.objective(_assigned(s, d)).select(F.round("objective", 6).alias("objective")),
    "cluster_stats": lambda s, d: bfr.cluster_stats(on.points(s, d)).select("cluster", F.col("dim").cast("int").alias("dim"), "n", F.round("sum", 6).alias("sum"), F.round("sumsq", 6).alias("sumsq")),
    "mahalanobis_assign": _mahalanobis,
    "cs_merge_pairs": _merge_pairs,
    "bfr_finalise": _finalise,
    "farthest_first": _centres,
    "kmeans_full": _kmeans,
    "bfr_full": lambda s, d: _bfr(s, d).finalise(),
    "bfr_round_report": lambda s, d: _bfr(s, d).round_report(),
}

# --- the same in SQL ---

REVIEWS = "reviews AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_suppkey AS supplier_id, ceil(l_quantity / 10) AS stars, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
BUSINESS = "business AS (SELECT p_partkey AS item_id, p_type || ', ' || p_brand AS categories FROM part)"
BASKETS = f"""pairs AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
need AS (SELECT ceil(count(DISTINCT basket) / {SHARE}.0) AS s FROM pairs)"""
#: All subsets of all baskets, without a largest size; ``part`` is the part of the first phase.
SUBSETS = f"""parted AS MATERIALIZED (SELECT *, basket % {SON_PARTS} AS part FROM pairs), sizes AS (SELECT part, count(DISTINCT basket) AS n FROM parted GROUP BY part),
occ(part, basket, items, last) AS (SELECT part, basket, [item], item FROM parted UNION ALL SELECT o.part, o.basket, list_append(o.items, p.item), p.item FROM occ o JOIN parted p ON p.basket = o.basket AND p.item > o.last),
counted AS MATERIALIZED (SELECT items, part, count(*) AS support FROM occ GROUP BY ALL),
candidates AS (SELECT DISTINCT items FROM counted JOIN sizes USING (part) WHERE support >= (SELECT s FROM need) * n / (SELECT sum(n) FROM sizes)),
frequent AS (SELECT items, CAST(sum(support) AS BIGINT) AS support FROM counted GROUP BY items HAVING sum(support) >= (SELECT s FROM need))"""
SHOWN = "array_to_string(items, ',') AS items"
LINES = "SELECT {section} AS section, CAST(len(items) AS INTEGER) AS size, string_agg('(' || chr(39) || array_to_string(items, chr(39) || ', ' || chr(39)) || chr(39) || ')', ',' ORDER BY items) AS line FROM {sets} GROUP BY len(items)"
HASHES = "hashes(hash, a, b, m) AS (VALUES " + ", ".join(map(str, minhash.parameters(50))) + ")"
MEMBERS = "members AS (SELECT DISTINCT item_id, user_id FROM reviews)"
SIGNATURES = f"{MEMBERS}, {HASHES}, sigs AS (SELECT item_id, hash, min((a * user_id + b) % m) AS value FROM members CROSS JOIN hashes GROUP BY 1, 2)"
MET = "met AS (SELECT DISTINCT x.item_id AS k1, y.item_id AS k2 FROM sigs x JOIN sigs y ON x.hash = y.hash AND x.value = y.value AND x.item_id < y.item_id)"
SHARED = """sizes AS (SELECT item_id, count(*) AS n FROM members GROUP BY 1),
shared AS (SELECT x.item_id AS k1, y.item_id AS k2, count(*) AS s FROM members x JOIN members y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2),
sims AS (SELECT k1, k2, s / (p.n + q.n - s) AS sim FROM shared JOIN sizes p ON p.item_id = k1 JOIN sizes q ON q.item_id = k2)"""


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


NORMAL = "replace(translate(lower(text), '([,.!?:;])' || chr(92), '           '), chr(10), '')"
for _old, _new in (("can''t", "can not"), ("won''t", "will not"), *((c.replace("'", "''"), " ") for c in ("'m", "'re", "'ve", "'s", "'ll", "'d"))):
    NORMAL = f"replace({NORMAL}, '{_old}', '{_new}')"
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace({NORMAL}, '[\p{{L}}\p{{N}}_]+n''t.', '', 'g'), '\$*\p{{Nd}}+', '', 'g'), '\p{{Nd}}+.', ' ', 'g')"
WORDS = rf"""words AS (SELECT doc_id, unnest(string_split(regexp_replace({NORMAL}, '^\s+|\s+$', '', 'g'), ' ')) AS word FROM documents),
raw AS (SELECT doc_id, word, count(*) AS f FROM words WHERE word NOT IN ({_list([*on.STOPWORDS, *MORE_STOPWORDS])}) GROUP BY 1, 2),
counts AS (SELECT * FROM raw WHERE word IN (SELECT word FROM raw GROUP BY word HAVING sum(f) * 1000000 >= (SELECT sum(f) FROM raw))),
scores AS (SELECT doc_id, word, round(f / max(f) OVER (PARTITION BY doc_id) * log2((SELECT count(DISTINCT doc_id) FROM counts) / count(*) OVER (PARTITION BY word)), 9) AS score FROM counts),
profile AS (SELECT doc_id, word FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) <= 200),
users AS (SELECT DISTINCT source, word FROM profile JOIN documents USING (doc_id))"""
RATINGS = "ratings AS (SELECT user_id, item_id, avg(stars) AS stars FROM reviews GROUP BY 1, 2)"
PEARSON = """CASE WHEN count(*) * sum(r1 * r2) - sum(r1) * sum(r2) > 1e-9 AND (count(*) * sum(r1 * r1) - sum(r1) * sum(r1)) * (count(*) * sum(r2 * r2) - sum(r2) * sum(r2)) > 1e-9
  THEN round((count(*) * sum(r1 * r2) - sum(r1) * sum(r2)) / sqrt((count(*) * sum(r1 * r1) - sum(r1) * sum(r1)) * (count(*) * sum(r2 * r2) - sum(r2) * sum(r2))), 9) END"""
ITEM_MODEL = f"""item_model AS (SELECT b1, b2, sim FROM (SELECT a.item_id AS b1, b.item_id AS b2, count(*) AS n, {PEARSON.replace("r1", "a.stars").replace("r2", "b.stars")} AS sim
  FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2) WHERE n >= 3 AND sim > 0)"""
USER_MODEL = f"""user_hashes(hash, a, b, m) AS (VALUES {", ".join(map(str, minhash.parameters(30)))}),
user_sets AS (SELECT user_id, item_id FROM ratings WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 3)),
user_sizes AS (SELECT user_id, count(*) AS n FROM user_sets GROUP BY 1),
user_sigs AS (SELECT user_id, hash, min((a * item_id + b) % m) AS value FROM user_sets CROSS JOIN user_hashes GROUP BY 1, 2),
user_met AS (SELECT DISTINCT x.user_id AS u1, y.user_id AS u2 FROM user_sigs x JOIN user_sigs y ON x.hash = y.hash AND x.value = y.value AND x.user_id < y.user_id),
user_model AS (SELECT u1, u2, sim FROM (SELECT u1, u2, count(*) AS n, any_value(p.n) AS n1, any_value(q.n) AS n2, {PEARSON.replace("r1", "a.stars").replace("r2", "b.stars")} AS sim
  FROM user_met JOIN ratings a ON a.user_id = u1 JOIN ratings b ON b.user_id = u2 AND b.item_id = a.item_id JOIN user_sizes p ON p.user_id = u1 JOIN user_sizes q ON q.user_id = u2 GROUP BY u1, u2)
  WHERE n >= 3 AND n / (n1 + n2 - n) >= 0.01 AND sim > 0)"""
POINTS = "points AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS INTEGER) AS cluster, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings)"
STEP = f"""{POINTS}, starts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS c FROM (SELECT DISTINCT id FROM points ORDER BY id LIMIT {K})),
far AS (SELECT p.id, c, sqrt(sum((p.x - s.x) * (p.x - s.x))) AS d FROM points p JOIN points s ON p.dim = s.dim JOIN starts ON starts.id = s.id GROUP BY 1, 2),
assigned AS (SELECT id, CAST(c AS INTEGER) AS cluster, d FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""
STATS = f"""{POINTS}, st AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM points GROUP BY 1, 2),
mv AS (SELECT cluster, dim, s / n AS m, greatest(0, q / n - (s / n) * (s / n)) AS v FROM st)"""

CENTRES = "pts AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m0 AS MATERIALIZED (SELECT 0 AS c, v FROM pts ORDER BY md5('49-' || id), id LIMIT 1)"
for _i in range(1, K):
    CENTRES += f""",
m{_i} AS MATERIALIZED (SELECT c, v FROM m{_i - 1} UNION ALL (SELECT {_i}, any_value(p.v) FROM pts p CROSS JOIN m{_i - 1} m GROUP BY id HAVING min(list_distance(p.v, m.v)) > 0 ORDER BY min(list_distance(p.v, m.v)) DESC, id LIMIT 1))"""
NEAREST = "SELECT id, p.v, c, list_distance(p.v, m.v) AS d FROM pts p CROSS JOIN {m} m QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(p.v, m.v), c) = 1"
CLUSTERED = f"{CENTRES}, a0 AS MATERIALIZED ({NEAREST.format(m=f'm{K - 1}')})"
for _i in range(1, SQL_ROUNDS):
    CLUSTERED += f""",
r{_i} AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY c) - 1 AS c, list(x ORDER BY k) AS v FROM (SELECT c, k, avg(x) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{_i - 1}) GROUP BY c, k) GROUP BY c),
a{_i} AS MATERIALIZED ({NEAREST.format(m=f"r{_i}")})"""

ORACLE_SQL: dict[str, str] = {
    "reviews_total": f"WITH {REVIEWS} SELECT count(*) AS n FROM reviews",
    "reviews_in_year": f"WITH {REVIEWS} SELECT count(*) AS n FROM reviews WHERE year(date) = {YEAR}",
    "distinct_users": f"WITH {REVIEWS} SELECT count(DISTINCT user_id) AS n FROM reviews",
    "top_users": f"WITH {REVIEWS} SELECT user_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, user_id LIMIT {TOP}",
    "top_words": rf"""WITH words AS (SELECT unnest(string_split(regexp_replace(translate(lower(text), '([,.!?:;])', ''), '^\s+|\s+$', '', 'g'), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM words WHERE regexp_replace(word, '^\s+|\s+$', '', 'g') NOT IN ({_list([*on.STOPWORDS, "", " "])}) GROUP BY 1 ORDER BY n DESC, word LIMIT {TOP}""",
    "category_avg_stars": f"WITH {REVIEWS}, {BUSINESS} SELECT trim(c) AS category, sum(stars) / count(stars) AS avg_stars FROM (SELECT unnest(string_split(categories, ',')) AS c, stars FROM reviews JOIN business USING (item_id)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}",
    "heavy_items": f"WITH {REVIEWS} SELECT item_id, count(*) AS n FROM reviews GROUP BY 1 HAVING count(*) > {HEAVY}",
    "partition_profile": f"WITH {REVIEWS} SELECT CAST(item_id % {PARTS} AS INTEGER) AS partition_id, count(*) AS n_items FROM reviews GROUP BY 1",
    "partition_rule": f"WITH {REVIEWS} SELECT CAST(item_id % {PARTS} AS INTEGER) AS partition_id, count(*) AS n_items FROM reviews GROUP BY 1",
    "state_user_item": f"WITH {REVIEWS} SELECT user_id, supplier_id FROM reviews JOIN supplier ON supplier_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = '{STATE}'",
    **{f"frequent_items_{k}": f"WITH RECURSIVE {BASKETS}, {SUBSETS} SELECT {SHOWN}, support FROM frequent WHERE len(items) = {k}" for k in (1, 2, 3)},
    "frequent_pairs_swapped": f"""WITH pairs AS (SELECT DISTINCT p_brand AS basket, p_type AS item FROM part)
SELECT a.item || ',' || b.item AS items, count(*) AS support FROM pairs a JOIN pairs b ON a.basket = b.basket AND a.item < b.item GROUP BY 1 HAVING count(*) >= {MOST_BRANDS}""",
    "son_candidates": f"WITH RECURSIVE {BASKETS}, {SUBSETS} SELECT {SHOWN} FROM candidates",
    "son_frequent": f"WITH RECURSIVE {BASKETS}, {SUBSETS} SELECT {SHOWN}, support FROM frequent",
    "itemset_report": f"""WITH RECURSIVE {BASKETS}, {SUBSETS} SELECT 0 AS section, 0 AS size, 'Candidates:' AS line UNION ALL {LINES.format(section=0, sets="candidates")}
UNION ALL SELECT 1, 0, 'Frequent Itemsets:' UNION ALL {LINES.format(section=1, sets="frequent")}""",
    "ratings_last": f"WITH {REVIEWS} SELECT user_id, item_id, first(stars ORDER BY date DESC, stars DESC) AS stars FROM reviews GROUP BY 1, 2",
    "minhash_signature": f"WITH {REVIEWS}, {SIGNATURES} SELECT item_id, hash, CAST(value AS BIGINT) AS value FROM sigs",
    "lsh_candidates": f"WITH {REVIEWS}, {SIGNATURES}, {MET} SELECT k1, k2 FROM met",
    "similar_items": f"WITH {REVIEWS}, {SIGNATURES}, {MET}, {SHARED} SELECT k1 AS b1, k2 AS b2, sim FROM sims JOIN met USING (k1, k2) WHERE sim >= 0.05",
    "similar_items_exact": f"WITH {REVIEWS}, {MEMBERS}, {SHARED} SELECT k1 AS b1, k2 AS b2, sim FROM sims WHERE sim >= 0.05",
    "tfidf_scores": f"WITH {WORDS} SELECT doc_id, word, score FROM scores",
    "business_profile": f"WITH {WORDS} SELECT doc_id, word FROM profile",
    "user_profile": f"WITH {WORDS} SELECT source, word FROM users",
    "content_predict": f"""WITH {WORDS} SELECT source, doc_id, sim FROM (SELECT source, doc_id, round(count(*) / sqrt(any_value(n1) * any_value(n2)), 9) AS sim
FROM users JOIN profile USING (word) JOIN (SELECT source, count(*) AS n1 FROM users GROUP BY 1) USING (source) JOIN (SELECT doc_id, count(*) AS n2 FROM profile GROUP BY 1) USING (doc_id) GROUP BY 1, 2) WHERE sim >= 0.01""",
    "item_cf_model": f"WITH {REVIEWS}, {RATINGS}, {ITEM_MODEL} SELECT b1, b2, sim FROM item_model",
    "user_cf_model": f"WITH {REVIEWS}, {RATINGS}, {USER_MODEL} SELECT u1, u2, sim FROM user_model",
    "item_cf_predict": f"""WITH {REVIEWS}, {RATINGS}, {ITEM_MODEL}, ways AS (SELECT b1 AS x, b2 AS y, sim FROM item_model UNION ALL SELECT b2, b1, sim FROM item_model),
top AS (SELECT t.user_id, t.item_id, sim, r.stars FROM ratings t JOIN ratings r ON r.user_id = t.user_id JOIN ways ON x = t.item_id AND y = r.item_id
  QUALIFY row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY sim DESC, r.item_id) <= {cf.ITEM_NEIGHBOURS})
SELECT user_id, item_id, round(sum(sim * stars) / sum(sim), 9) AS stars FROM top GROUP BY 1, 2 HAVING sum(sim * stars) / sum(sim) > 0""",
    "user_cf_predict": f"""WITH {REVIEWS}, {RATINGS}, {USER_MODEL}, ways AS (SELECT u1 AS x, u2 AS y, sim FROM user_model UNION ALL SELECT u2, u1, sim FROM user_model),
common AS (SELECT x, y, sim, avg(b.stars) AS base FROM ways JOIN ratings a ON a.user_id = x JOIN ratings b ON b.user_id = y AND b.item_id = a.item_id GROUP BY 1, 2, 3),
top AS (SELECT x, t.item_id, sim, r.stars - base AS gap FROM ratings t JOIN ratings r ON r.item_id = t.item_id JOIN common ON x = t.user_id AND y = r.user_id
  QUALIFY row_number() OVER (PARTITION BY x, t.item_id ORDER BY sim DESC, y) <= {cf.USER_NEIGHBOURS})
SELECT x AS user_id, item_id, round(any_value(mean) + sum(gap * sim) / sum(sim), 9) AS stars FROM top JOIN (SELECT user_id, avg(stars) AS mean FROM ratings GROUP BY 1) m ON m.user_id = x
GROUP BY 1, 2 HAVING any_value(mean) + sum(gap * sim) / sum(sim) > 0""",
    "kmeans_assign_step": f"WITH {STEP} SELECT id, cluster FROM assigned",
    "kmeans_centroid_step": f"WITH {STEP} SELECT a.cluster, dim, round(avg(x), 6) AS value FROM assigned a JOIN points p ON p.id = a.id GROUP BY 1, 2",
    "kmeans_objective": f"WITH {STEP} SELECT round(sum(d), 6) AS objective FROM assigned",
    "farthest_first": f"WITH {CENTRES} SELECT c AS cluster, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, unnest(v) AS value FROM m{K - 1}",
    "kmeans_full": f"WITH {CLUSTERED} SELECT id, CAST(c AS INTEGER) AS cluster, round(d, 6) AS distance FROM a{SQL_ROUNDS - 1}",
    "cluster_stats": f"WITH {STATS} SELECT cluster, dim, n, round(s, 6) AS sum, round(q, 6) AS sumsq FROM st",
    "mahalanobis_assign": f"""WITH {STATS}, far AS (SELECT id, mv.cluster AS c, sqrt(sum(CASE WHEN v > 0 THEN (x - m) * (x - m) / v WHEN x = m THEN 0 ELSE 'inf'::DOUBLE END)) AS d, count(*) AS dims FROM points JOIN mv ON mv.dim = points.dim GROUP BY 1, 2)
SELECT id, CAST(CASE WHEN d <= 2 * sqrt(dims) THEN c ELSE -1 END AS INTEGER) AS cluster FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1""",
    "cs_merge_pairs": f"""WITH {STATS}, far AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS dims,
  sqrt(sum(CASE WHEN a.v > 0 THEN (a.m - b.m) * (a.m - b.m) / a.v WHEN a.m = b.m THEN 0 ELSE 'inf'::DOUBLE END)) AS d1,
  sqrt(sum(CASE WHEN b.v > 0 THEN (a.m - b.m) * (a.m - b.m) / b.v WHEN a.m = b.m THEN 0 ELSE 'inf'::DOUBLE END)) AS d2
  FROM mv a JOIN mv b ON a.dim = b.dim AND a.cluster < b.cluster GROUP BY 1, 2)
SELECT a, b FROM far WHERE least(d1, d2) <= 2 * sqrt(dims)""",
    "bfr_finalise": f"""WITH {STATS}, far AS (SELECT id, mv.cluster AS c, sqrt(sum((x - m) * (x - m))) AS d FROM points JOIN mv ON mv.dim = points.dim GROUP BY 1, 2)
SELECT id, CAST(c AS INTEGER) AS cluster FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1""",
}
