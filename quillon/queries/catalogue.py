"""Filters, counts and statistics over a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, blocks, checks, filters, joins, sets
from ..plans.stand_ins import RATINGS_SQL, SHOWS_SQL, ratings, shows
from ..sources.tables import table
from . import Query


def eligible_pool(spark: SparkSession, d: str) -> DataFrame:
    return filters.pool(shows(spark, d), ratings(spark, d).where("user_id % 50 = 0"), filters.Settings(language="English", rating_min=6.0, year_min=1960)).select("user_id", "id")


def discovery_sort(spark: SparkSession, d: str) -> DataFrame:
    s = shows(spark, d).withColumn("genres", F.split("name", " "))
    hits = s.where(filters.discovery({"genres": ["red", "gear"], "rating": 6.5, "length": "half-hour", "status": "Running"}))
    return hits.select("id", "name", "rating", "year").orderBy(F.desc_nulls_last("rating"), F.desc("year"), "id").limit(50)


def recipe_masks(spark: SparkSession, d: str) -> DataFrame:
    return shows(spark, d).where(filters.mask_recipe(F.col("genre_bits"), [[0, 1], [3, 5]])).select("id", "genre_bits")


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.audit(shows(spark, d), ["type", "status"], recommendable=F.col("recommendable"), rated=F.col("rating").isNotNull()).withColumn("level", F.col("level").cast("long"))


def feature_lift(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("feature"))
    liked = ratings(spark, d).where("weight >= 0.7").select("id")
    out = aggregates.prevalence(items, liked, "id", "feature")
    return out.select("feature", "liked_count", "baseline_count", *(F.round(c, 6).alias(c) for c in ("share", "baseline", "lift")))


def fit_shares(spark: SparkSession, d: str) -> DataFrame:
    rated = ratings(spark, d).where("weight > 0").join(shows(spark, d).select("id", "name", "summary_words"), "id").withColumn("genres", F.when(F.col("summary_words") >= 15, F.split("name", " ")))
    return aggregates.fit_shares(rated, "user_id", "genres")


def context_mode(spark: SparkSession, d: str) -> DataFrame:
    rated = ratings(spark, d).where("weight > 0").join(shows(spark, d).select("id", "language"), "id")
    return aggregates.most_common(rated, "user_id", "language")


def list_breadth(spark: SparkSession, d: str) -> DataFrame:
    rated = ratings(spark, d).where("weight > 0").join(shows(spark, d).select("id", "name"), "id").withColumn("genres", F.split("name", " "))
    return aggregates.breadth(rated, "user_id", genres="genres").withColumn("genres", F.col("genres").cast("long"))


def rating_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.rating_counts(ratings(spark, d), "user_id").withColumn("liked_weight", F.round("liked_weight", 6))


_FLAG = {"f0": "genre_bits % 2", "f1": "genre_bits // 2 % 2", "f2": "theme_bits % 2", "f3": "CASE WHEN popularity > 50 THEN 1 ELSE 0 END"}


def phi_correlation(spark: SparkSession, d: str) -> DataFrame:
    flags = shows(spark, d).selectExpr("genre_bits % 2 AS f0", "genre_bits div 2 % 2 AS f1", "theme_bits % 2 AS f2", "CASE WHEN popularity > 50 THEN 1 ELSE 0 END AS f3")
    return aggregates.phi(flags, list(_FLAG)).withColumn("phi", F.round("phi", 6))


def _phi_sql() -> str:
    names = list(_FLAG)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS phi FROM fl" for i, a in enumerate(names) for b in names[i + 1 :])
    return f"WITH {SHOWS_SQL}, fl AS (SELECT {', '.join(f'({e})::DOUBLE AS {k}' for k, e in _FLAG.items())} FROM shows) {pairs}"


def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.spearman(shows(spark, d), ["rating", "runtime", "popularity"]).withColumn("rho", F.round("rho", 6))


def _spearman_sql() -> str:
    names = ["rating", "runtime", "popularity"]
    part = "SELECT '{a}' AS a, '{b}' AS b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM shows WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    pairs = " UNION ALL ".join(part.format(a=a, b=b) for i, a in enumerate(names) for b in names[i + 1 :])
    rank = "rank() OVER (PARTITION BY a, b ORDER BY {0}) + (count(*) OVER (PARTITION BY a, b, {0}) - 1) / 2.0"
    return f"WITH {SHOWS_SQL}, p AS ({pairs}), r AS (SELECT a, b, {rank.format('x')} AS rx, {rank.format('y')} AS ry FROM p) SELECT a, b, round(corr(rx, ry), 6) AS rho, count(*) AS pairs FROM r GROUP BY a, b"


def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.midrank(shows(spark, d), "popularity").withColumn("percentile", F.round("percentile", 9))


def q75_index(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.index_quantile(shows(spark, d), "type", "rating", 0.75)


def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.nearest_rank(table(spark, d, "events"), "event_type", "value", (0.5, 0.95, 0.99))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram_percentiles(table(spark, d, "events"), "value", 0.5, (0.5, 0.95, 0.99))


def rank_share(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.rank_share(shows(spark, d).where("rating is not null"), "type", "rating", "id").select("id", F.round("share", 9).alias("share"))


def combination_table(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.combination_table(shows(spark, d), "genre_bits")


def evaluation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of held-out labels: the stand-in ranks documents by length and holds out those labelled."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    held = table(spark, d, "labels").join(docs, "doc_id").withColumn("rank", F.when(F.col("toxic") == 0, F.col("rank")))
    out = aggregates.hit_rates(held, ["lang"])
    return out.select("lang", F.col("pooled").cast("long").alias("pooled"), "n", *(F.round(c, 9).alias(c) for c in ("hr10", "hr24", "hr100", "mrr")), F.col("median_rank").cast("long").alias("median_rank"))


def bitset_cosine(spark: SparkSession, d: str) -> DataFrame:
    flags = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit(F.col("genre_bits"), k) == 1)
    rows = shows(spark, d).select(F.col("id").cast("long").alias("id"), flags.alias("cols")).withColumn("vals", F.transform("cols", lambda k: 1 / F.sqrt(F.size("cols").cast("double"))))
    near = blocks.nearest(rows.where("id % 50 = 0"), rows, 5, -1.0)
    return near.select("a", "b", F.round("score", 9).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def popularity_track(spark: SparkSession, d: str) -> DataFrame:
    track = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg((F.count("*") * 12 - 20).alias("weight"))
    return joins.with_track(shows(spark, d).select("id"), track, "id", "weight")


def catalogue_checks(spark: SparkSession, d: str) -> DataFrame:
    s = shows(spark, d)
    return checks.rule_violations(s, "id", {"rating range": F.col("rating").between(6, 9.5), "has language": F.col("language").isNotNull(), "runtime": F.col("runtime") > 3})


def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    o = checks.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")
    return o.select("o_orderkey", "o_custkey")


def version_shift(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return checks.size_shift(o, o.where("o_orderstatus <> 'F'"))


def index_completeness(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return checks.missing_both_ways(left, right)


def facet_tree(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_type", "p_brand", "p_size").agg(F.count("*").alias("n"))
    return sets.merge_small(counts, ["p_type", "p_brand", "p_size"], 10)


_ELIG = "recommendable AND year >= 1960 AND popularity >= 60 AND coalesce(language, 'unknown') = 'English' AND coalesce(rating >= 6.0, false)"

QUERIES = [
    Query("eligible_pool", eligible_pool, f"WITH {SHOWS_SQL}, {RATINGS_SQL}, u AS (SELECT DISTINCT user_id FROM ratings WHERE user_id % 50 = 0) SELECT user_id, id FROM shows, u WHERE {_ELIG} AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id AND r.id = shows.id)"),
    Query("discovery_filter_sort", discovery_sort, f"WITH {SHOWS_SQL} SELECT id, name, rating, year FROM shows WHERE list_has_any(string_split(name, ' '), ['red', 'gear']) AND rating >= 6.5 AND runtime BETWEEN 21 AND 40 AND status = 'Running' ORDER BY rating DESC NULLS LAST, year DESC, id LIMIT 50"),
    Query("recipe_masks", recipe_masks, f"WITH {SHOWS_SQL} SELECT id, genre_bits FROM shows WHERE genre_bits & 3 <> 0 AND genre_bits & 40 <> 0"),
    Query("audit_counts", audit_counts, f"WITH {SHOWS_SQL} SELECT type, status, grouping(type, status)::BIGINT AS level, count(*) AS n, count(*) FILTER (recommendable) AS recommendable, count(*) FILTER (rating IS NOT NULL) AS rated FROM shows GROUP BY GROUPING SETS ((), (type), (status))"),
    Query("feature_lift", feature_lift, f"WITH {RATINGS_SQL}, items AS (SELECT DISTINCT id, feature FROM (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS feature FROM part)), liked AS (SELECT DISTINCT id FROM ratings WHERE weight >= 0.7 AND id IN (SELECT id FROM items)), t AS (SELECT count(DISTINCT id) AS n FROM items), l AS (SELECT count(*) AS n FROM liked), c AS (SELECT feature, count(*) AS baseline_count, count(*) FILTER (id IN (SELECT id FROM liked)) AS liked_count FROM items GROUP BY feature) SELECT feature, liked_count, baseline_count, round(liked_count / l.n, 6) AS share, round(baseline_count / t.n, 6) AS baseline, round((liked_count / l.n) / (baseline_count / t.n), 6) AS lift FROM c, t, l"),
    Query("fit_shares", fit_shares, f"WITH {SHOWS_SQL}, {RATINGS_SQL}, k AS (SELECT r.user_id, r.weight, list_distinct(string_split(s.name, ' ')) AS g FROM ratings r JOIN shows s USING (id) WHERE weight > 0 AND summary_words >= 15), t AS (SELECT user_id, sum(weight) AS total FROM k GROUP BY user_id), m AS (SELECT user_id, feature, sum(weight) AS mass FROM (SELECT user_id, weight, unnest(g) AS feature FROM k) GROUP BY ALL) SELECT m.user_id, feature, floor(round(mass / total * 100, 9) + 0.5)::BIGINT AS share FROM m JOIN t ON m.user_id = t.user_id WHERE floor(round(mass / total * 100, 9) + 0.5) > 0"),
    Query("context_mode", context_mode, f"WITH {SHOWS_SQL}, {RATINGS_SQL}, c AS (SELECT user_id, language, count(*) AS n FROM ratings JOIN shows USING (id) WHERE weight > 0 AND language IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, language DESC) AS k, (sum(n) OVER (PARTITION BY user_id))::BIGINT AS tot FROM c) SELECT user_id, language AS value, n AS count, tot AS \"of\" FROM r WHERE k = 1"),
    Query("list_breadth", list_breadth, f"WITH {SHOWS_SQL}, {RATINGS_SQL} SELECT user_id, count(DISTINCT g) AS genres FROM (SELECT user_id, unnest(string_split(name, ' ')) AS g FROM ratings JOIN shows USING (id) WHERE weight > 0) GROUP BY user_id"),
    Query("rating_counts", rating_counts, f"WITH {RATINGS_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (weight = 1) AS loves, count(*) FILTER (weight = 0.7) AS likes, count(*) FILTER (weight = 0.35) AS oks, count(*) FILTER (weight = 0) AS neutrals, count(*) FILTER (weight < 0) AS dislikes, count(*) FILTER (weight > 0) AS liked, count(*) FILTER (weight <> 0) AS scored, round(sum(CASE WHEN weight > 0 THEN weight ELSE 0 END), 6) AS liked_weight FROM ratings GROUP BY user_id"),
    Query("phi_correlation", phi_correlation, _phi_sql()),
    Query("spearman_matrix", spearman_matrix, _spearman_sql()),
    Query("midrank_percentile", midrank_percentile, f"WITH {SHOWS_SQL} SELECT popularity, round((coalesce(sum(c) OVER (ORDER BY popularity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c / 2) / sum(c) OVER (), 9) AS percentile FROM (SELECT popularity, count(*) AS c FROM shows GROUP BY popularity)"),
    Query("q75_index", q75_index, f"WITH {SHOWS_SQL}, r AS (SELECT type, rating, row_number() OVER (PARTITION BY type ORDER BY rating) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM shows WHERE rating IS NOT NULL) SELECT type, rating AS quantile FROM r WHERE i = floor(0.75 * (n - 1))"),
    Query("nearest_rank", nearest_rank, "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = least(n - 1, floor(0.5 * n))) AS p50, max(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95, max(value) FILTER (i = least(n - 1, floor(0.99 * n))) AS p99 FROM r GROUP BY event_type"),
    Query("latency_percentiles", latency_percentiles, "WITH b AS (SELECT floor(value / 0.5) AS bin, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS cum, sum(c) OVER () AS n FROM b) SELECT min(CASE WHEN cum >= 0.5 * n THEN (bin + 1) * 0.5 END)::DOUBLE AS p50, min(CASE WHEN cum >= 0.95 * n THEN (bin + 1) * 0.5 END)::DOUBLE AS p95, min(CASE WHEN cum >= 0.99 * n THEN (bin + 1) * 0.5 END)::DOUBLE AS p99 FROM c"),
    Query("rank_share", rank_share, f"WITH {SHOWS_SQL} SELECT id, round(1 - (row_number() OVER (PARTITION BY type ORDER BY rating DESC, id) - 1) / (count(*) OVER (PARTITION BY type) - 1), 9) AS share FROM shows WHERE rating IS NOT NULL"),
    Query("combination_table", combination_table, f"WITH {SHOWS_SQL} SELECT genre_bits, count(*) AS rows, row_number() OVER (ORDER BY genre_bits) - 1 AS code FROM shows GROUP BY genre_bits"),
    Query("hit_rate_mrr", evaluation_metrics, "WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk FROM documents), h AS (SELECT lang, CASE WHEN toxic = 0 THEN rk END AS rk FROM labels JOIN d USING (doc_id)) SELECT lang, grouping(lang)::BIGINT AS pooled, count(*) AS n, round(avg((coalesce(rk, 2147483647) <= 10)::INT), 9) AS hr10, round(avg((coalesce(rk, 2147483647) <= 24)::INT), 9) AS hr24, round(avg((coalesce(rk, 2147483647) <= 100)::INT), 9) AS hr100, round(avg(coalesce(1 / rk, 0)), 9) AS mrr, nullif(quantile_disc(coalesce(rk, 2147483647), 0.5), 2147483647)::BIGINT AS median_rank FROM h GROUP BY GROUPING SETS ((), (lang))"),
    Query("bitset_cosine_topk", bitset_cosine, f"WITH {SHOWS_SQL}, c AS (SELECT q.id AS a, s.id AS b, round(CASE WHEN q.genre_bits = 0 OR s.genre_bits = 0 THEN 0 ELSE bit_count(q.genre_bits & s.genre_bits) / sqrt(bit_count(q.genre_bits)::DOUBLE * bit_count(s.genre_bits)) END, 9) AS cosine FROM shows s JOIN shows q ON q.id % 50 = 0 AND q.id <> s.id) SELECT * FROM (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c) WHERE rank <= 5"),
    Query("popularity_track", popularity_track, f"WITH {SHOWS_SQL}, t AS (SELECT l_partkey AS id, greatest(0, least(100, count(*) * 12 - 20)) AS weight FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) SELECT id, coalesce(weight, 0)::BIGINT AS weight FROM shows LEFT JOIN t USING (id)"),
    Query("catalogue_checks", catalogue_checks, f"WITH {SHOWS_SQL} SELECT id, 'rating range' AS rule FROM shows WHERE NOT coalesce(rating BETWEEN 6 AND 9.5, false) UNION ALL SELECT id, 'has language' FROM shows WHERE language IS NULL UNION ALL SELECT id, 'runtime' FROM shows WHERE NOT coalesce(runtime > 3, false)"),
    Query("orphan_check", orphan_check, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    Query("version_shift", version_shift, "SELECT * FROM (SELECT (SELECT count(*) FROM orders) AS n_before, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS n_after) WHERE abs(n_after - n_before) > 0.1 * n_before"),
    Query("index_completeness", index_completeness, "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)"),
    Query("facet_tree_merge", facet_tree, "WITH a AS (SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_type, p_brand, CASE WHEN n < 10 THEN NULL ELSE p_size END AS p_size, sum(n) AS n FROM a GROUP BY ALL), c AS (SELECT p_type, CASE WHEN n < 10 AND p_brand IS NOT NULL THEN NULL ELSE p_brand END AS p_brand, CASE WHEN n < 10 AND p_brand IS NOT NULL THEN NULL ELSE p_size END AS p_size, sum(n) AS n FROM b GROUP BY ALL) SELECT p_type, p_brand, p_size, sum(n)::BIGINT AS n FROM c GROUP BY ALL"),
]
