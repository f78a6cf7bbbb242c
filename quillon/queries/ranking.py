"""Ranking and the order of what is shown. Searches over the whole catalogue are for the users whose id is divisible by 50; pages,
rows and clusters are of all users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.noise import gumbel, hash_uniform
from ..operators import aggregates, evaluate, ranking, recipes, rows, study, vectors
from ..operators.filters import Settings
from ..plans import recommend as whole
from ..plans.stand_ins import RATINGS_SQL, SHOWS_SQL, attributes, ratings, shows
from ..sources.tables import materialise, table
from . import Query
from .lists import base
from .model import ASKED, CO_SQL, FACET_SQL, NEAR_SQL, asked, cells, co_interest


def lists(spark: SparkSession, d: str) -> DataFrame:
    return ratings(spark, d).where(f"user_id % {ASKED} = 0")


def links(spark: SparkSession, d: str) -> DataFrame:
    return co_interest(spark, d).select("a", "b", F.col("s").alias("near"))


def liked(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).where("weight > 0").select("user_id", "pos", "id", "weight", F.lit(0).alias("interest"))


def pool(lk: DataFrame, rated: DataFrame, edges: DataFrame) -> DataFrame:
    """user_id, id of the unrated shows that a liked show links to; no other has a score."""
    reached = lk.select("user_id", F.col("id").alias("a")).join(edges, "a").select("user_id", F.col("b").alias("id")).distinct()
    return reached.join(rated.select("user_id", "id"), ["user_id", "id"], "left_anti")


def single(spark: SparkSession, d: str) -> DataFrame:
    rated, e = materialise(lists(spark, d)), materialise(links(spark, d))
    lk = rated.where("weight > 0").select("user_id", "pos", "id", "weight", F.lit(0).alias("interest"))
    c = materialise(pool(lk, rated, e))
    factors = shows(spark, d).select("id", (1 + F.col("popularity") / 100).alias("factor"))
    penalty = ranking.penalties(c, rated.where("weight < 0").select("user_id", "id"), e)
    return ranking.scores(ranking.interest_hits(c, lk, e), penalty, factors, lk)


def rank_single_interest(spark, d):
    return ranking.picks(single(spark, d)).select("user_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def explain_closest_source(spark, d):
    return ranking.closest_source(ranking.picks(single(spark, d)), liked(spark, d), links(spark, d))


def taste_match(spark, d):
    return ranking.taste_match(single(spark, d)).select("user_id", "id", F.col("match").cast("long").alias("match"))


def wide(spark, d):
    from ..functions.dates import faded

    n = F.count("*").over(Window.partitionBy("user_id"))
    every = ratings(spark, d).where("weight > 0").select("user_id", "pos", "id", "weight", F.lit(0).alias("interest"))
    lk = every.withColumn("fade", faded(F.col("pos"), n))
    e = materialise(co_interest(spark, d))
    evidence = vectors.evidence(e.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("s").alias("t"), F.lit(0.5).alias("y"), F.lit(0.0).alias("f")), vectors.degrees(e, "b"), 10)
    return ranking.wide_scores(lk, evidence).select("user_id", F.col("j").alias("id"), F.round("score", 6).alias("score"))


def disliked_nearness(spark, d):
    return ranking.disliked_nearness(ratings(spark, d).where("weight < 0"), links(spark, d))


def interest_clusters(spark, d):
    return ranking.interests(ratings(spark, d).where("weight > 0").select("user_id", "pos", "id", "weight"), links(spark, d))


def recommended(spark, d):
    s = shows(spark, d)
    return whole.recommend(s, lists(spark, d), links(spark, d), attributes(s), base(spark, d), Settings(known_min=0))


def study_ranking(spark, d):
    seeds = asked(spark, d).select("id", F.when(F.col("id") % 100 == 0, 1.0).otherwise(0.7).alias("weight"))
    out = study.scores_of_vectors(shows(spark, d).select("id"), seeds, vectors.cell_vectors(cells(spark, d)))
    return out.select("id", F.round("score", 6).alias("score"))


def sensitivity(spark, d):
    parts = shows(spark, d).select("id", (F.col("popularity") / 100).alias("t"), (F.col("theme_bits") / 128).alias("h"), (F.col("genre_bits") / 64).alias("g"))
    return evaluate.variants(parts, {"base": (0.4, 0.35, 0.25), "text": (1.0, 0.0, 0.0), "even": (1.0, 1.0, 1.0)})


def sensitivity_ranks(spark, d):
    return sensitivity(spark, d).select("id", "variant", "score", "rank")


def sensitivity_overlap(spark, d):
    return evaluate.top_overlap(sensitivity(spark, d), "base")


def correlation_pairs(spark, d):
    rho = aggregates.spearman(shows(spark, d), ["popularity", "rating", "runtime"])
    return evaluate.strongest_pairs(rho, "rho").select("a", "b", F.round("rho", 6).alias("rho"))


def competition(spark, d):
    return rows.competition_place(shows(spark, d).select("type", "id", "popularity"), "type", "popularity", "id").select("id", F.col("place").cast("long").alias("place"))


# ------------------------------------------------------------------ order of what is shown


def ranked(spark: SparkSession, d: str) -> DataFrame:
    s = shows(spark, d).select("type", "id", "network", "popularity")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("popularity"), "id")))


def noise(surface: str):
    return gumbel(hash_uniform(F.lit(surface), F.col("id").cast("string")))


def _placed(df: DataFrame) -> DataFrame:
    return df.select("type", "id", F.col("place").cast("long").alias("place"))


def spread_rank(spark, d):
    return _placed(ranking.spread(ranked(spark, d), "type", "rank", "id", "network"))


def dithered(spark, d):
    return _placed(ranking.dither(ranked(spark, d), "type", "rank", "id", F.col("id") % 3, noise("dither")))


def rotated(spark, d):
    return _placed(ranking.rotate(ranked(spark, d), "type", "rank", "id", F.col("id") % 3, noise("rotate"), 2))


def drawn(spark, d):
    return ranking.draw_one(ranked(spark, d), "type", "rank", "id", F.col("id") % 4 == 0, noise("draw"))


def explored(spark, d):
    r = ranked(spark, d)
    shown = r.where("rank <= 24").select("type", "id", F.col("rank").alias("place"))
    out = ranking.explore(shown, r, "type", "id", hash_uniform(F.lit("explore"), F.col("id").cast("string")), score="popularity")
    return out.select("type", "id", F.col("place").cast("long").alias("place"), "different")


def shuffled_rows(spark, d):
    r = ranked(spark, d).where("rank <= 12")
    return _placed(ranking.shuffle_rows(r, "type", "rank", "id", F.col("id") % 5 == 0, noise("rows")))


def softmax_draws(spark, d):
    return rows.softmax_draw(shows(spark, d).select("type", "id", (F.col("popularity") / 100).alias("score")), "type", "id", "score", noise("starter"))


def default_order(spark, d):
    s = shows(spark, d).select("type", "id", F.col("genre_bits").alias("taste"), (F.col("popularity") / 100).alias("known"), (F.coalesce("rating", F.lit(5.0)) / 10).alias("quality"))
    return _placed(ranking.blended_order(s, "type", "taste", "known", "quality", "id"))


def relevance(spark, d):
    r = ranked(spark, d).where("rank <= 30").withColumn("fit", F.col("popularity") / 100)
    return ranking.row_relevance(r, ["type"], "fit", "rank", F.lit(0.8)).withColumn("relevance", F.round("relevance", 6))


def hidden_gems(spark, d):
    s = shows(spark, d)
    q = aggregates.index_quantile(s, "type", "rating", 0.75).withColumnRenamed("quantile", "q75")
    scored = s.join(q, "type").select("type", "id", ((F.col("id") * 31 % 101) / 100).alias("taste"), (F.col("popularity") / 100).alias("popularity"), "rating", "q75", (F.col("rating") / 10).alias("quality"))
    return _placed(rows.hidden_gems(scored, "type"))


def browse_rows(spark, d):
    s = shows(spark, d).withColumn("genres", F.split("name", " "))
    return rows.browse(s, "genres").select("genre", "row", F.col("place").cast("long").alias("place"), "id")


def tagged_rows(spark, d):
    kinds = [("acclaimed", F.col("rating") >= 8.5, [F.desc("rating"), F.desc("popularity")]), ("gems", F.col("popularity") < 40, [F.desc_nulls_last("rating")]), ("decade", F.col("year").between(1990, 1999), [F.desc("popularity")])]
    return rows.tagged_rows(kinds, shows(spark, d), 15).select("row", F.col("place").cast("long").alias("place"), "id")


def row_titles(spark, d):
    s = shows(spark, d)
    title = rows.row_title(F.when(F.col("rating") > 9, "acclaimed"), F.lower("language"), F.element_at(F.split("name", " "), 2), F.lit("series"), F.when(F.col("year") >= 1990, F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s"))))
    return s.select("id", title.alias("title"))


def row_recipes(spark, d):
    """Micro-genres of every user's liked shows: subject and adjective by name, form by type, place by language, era by decade."""
    s = shows(spark, d)
    of = {"core": F.concat(F.split("name", " ")[1], F.lit("s")), "form": F.lower("type"), "place": F.col("language"), "adjective": F.split("name", " ")[0], "era": F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s"))}
    parts = materialise(s.select("id", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), c.alias("words")) for r, c in of.items()))).alias("p")).select("id", "p.*"))
    members = ratings(spark, d).where("weight > 0").select(F.col("user_id").alias("interest"), "id").join(s.select("id"), "id", "left_semi")
    out = recipes.recipes(members, parts, s.count(), niche=8)
    return out.select("interest", F.col("place").cast("long").alias("place"), "name", "support", "shows", F.round("lift", 6).alias("lift"))


def starter_scores(spark, d):
    s = shows(spark, d).select("id", "type", "popularity")
    tags = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tags"))
    from ..operators.sets import total_likeness

    out = rows.starter_scores(s, total_likeness(tags, "type", "id", "tags"), "type", "popularity")
    return out.select("id", "type", F.round("score", 6).alias("score"))


def _liked_types(spark, d):
    """user_id, type, share of each user's liked shows."""
    liked = ratings(spark, d).where("weight > 0").join(shows(spark, d).select("id", "type"), "id").groupBy("user_id", "type").agg(F.count("*").alias("n"))
    return liked.select("user_id", "type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


def _offered(spark, d, most):
    """For every user the best shows of each type they like, without those they have rated."""
    best = ranked(spark, d).where(F.col("rank") <= most).select("type", "id", "rank", "popularity")
    return _liked_types(spark, d).join(best, "type").join(ratings(spark, d).select("user_id", "id"), ["user_id", "id"], "left_anti")


def _candidate_rows(spark, d):
    """Rows of every user's page: a row a type that they like, of interests that hold the most and the second most."""
    cards = _offered(spark, d, 12).groupBy("user_id", F.col("type").alias("row"), "share").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("cards"), F.avg(F.col("popularity") / 100).alias("relevance"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("share"), "row"))
    return cards.withColumn("k", k).withColumn("interest", F.when(F.col("k") <= 2, F.col("k") - 1).cast("int")).withColumn("share", F.when(F.col("k") <= 2, F.col("share"))).withColumn("kind", F.substring("row", 1, 1)).drop("k")


def arrange_rows(spark, d):
    return ranking.arrange(_candidate_rows(spark, d))


def deduplicated_cards(spark, d):
    r = materialise(_candidate_rows(spark, d))
    facts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand").alias("franchise"), F.array("p_brand").alias("creators"))
    return ranking.dedup_cards(ranking.arrange(r).join(r.select("user_id", "row", "cards"), ["user_id", "row"]), facts)


def calibrated(spark, d):
    """Twenty shows of every user's types, calibrated to the genres of the shows they like."""
    genres = shows(spark, d).select("id", F.split("name", " ").alias("genres"))
    offered = _offered(spark, d, 40).join(genres, "id").select("user_id", "id", (F.col("popularity") / 100 * (0.5 + F.col("share") / 2)).alias("score"), "genres")
    liked = ratings(spark, d).where("weight > 0").join(genres, "id").select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    target = liked.select("user_id", "genre", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("p"))
    return ranking.calibrate(offered, target, 20)


def page_scores(spark, d):
    cards = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 1).alias("row"), "l_partkey", (F.col("l_returnflag") == "R").alias("hit"))
    out = aggregates.page_scores(cards, "l_suppkey", "row", "l_partkey", "hit")
    return out.select("l_suppkey", *(F.col(c).cast("long").alias(c) for c in ("first_3", "first_8", "anywhere", "distinct_cards", "repeats", "rows")))


_U = "((('0x' || substr(sha256('{0}|' || id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496)"
_G = lambda s: f"(-ln(-ln({_U.format(s)})))"
_LISTS = f"{SHOWS_SQL}, {RATINGS_SQL}, {CO_SQL}"
_SINGLE = f"""
lk AS (SELECT user_id, id, weight, pos FROM ratings WHERE weight > 0 AND user_id % {ASKED} = 0),
nm AS (SELECT user_id, sum(weight) AS norm, max(weight) AS top FROM lk GROUP BY user_id),
hit AS (SELECT lk.user_id, co.b AS id, 0.7 * sum(weight / norm * s) + 0.3 * max(weight / top * s) AS hit FROM lk JOIN nm ON nm.user_id = lk.user_id JOIN co ON co.a = lk.id GROUP BY ALL),
dl AS (SELECT user_id, id FROM ratings WHERE weight < 0 AND user_id % {ASKED} = 0),
pen AS (SELECT dl.user_id, co.b AS id, 0.35 * sum(s) / any_value(n) AS p FROM dl JOIN co ON co.a = dl.id JOIN (SELECT user_id, count(*) AS n FROM dl GROUP BY user_id) q ON q.user_id = dl.user_id GROUP BY ALL),
rw AS (SELECT h.user_id, h.id, greatest(hit - coalesce(p, 0), 0) * (1 + popularity / 100) AS raw FROM hit h JOIN shows ON shows.id = h.id ANTI JOIN ratings r ON r.user_id = h.user_id AND r.id = h.id LEFT JOIN pen ON pen.user_id = h.user_id AND pen.id = h.id),
sc AS (SELECT user_id, id, round(raw / max(raw) OVER (PARTITION BY user_id), 9) AS score FROM rw QUALIFY raw > 0),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 24)"""
_RK = f"WITH {SHOWS_SQL}, rk AS (SELECT type, id, network, popularity, row_number() OVER (PARTITION BY type ORDER BY popularity DESC, id) AS rank FROM shows)"
_VARIANTS = "v AS (SELECT id, 'base' AS variant, round((0.4 * t + 0.35 * h + 0.25 * g) / (0.4 + 0.35 + 0.25), 9) AS score FROM p UNION ALL SELECT id, 'text', round(t, 9) FROM p UNION ALL SELECT id, 'even', round((t + h + g) / 3, 9) FROM p), rr AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY score DESC) + (count(*) OVER (PARTITION BY variant, score) - 1) / 2 AS rank FROM v)"
_PARTS = f"WITH {SHOWS_SQL}, p AS (SELECT id, popularity / 100 AS t, theme_bits / 128 AS h, genre_bits / 64 AS g FROM shows), {_VARIANTS}"
_BROWSE = {"top": "round(popularity * greatest(coalesce(rating, -1), 0), 6) DESC", "new": "year DESC, popularity DESC", "acclaimed": "coalesce(rating, -1) DESC, popularity DESC", "popular": "popularity DESC, coalesce(rating, -1) DESC"}

QUERIES = [
    Query("rank_single_interest", rank_single_interest, f"WITH {_LISTS}, {_SINGLE} SELECT user_id, id, round(score, 6) AS score, rank FROM pk"),
    Query("explain_closest_source", explain_closest_source, f"WITH {_LISTS}, {_SINGLE}, c AS (SELECT pk.user_id, pk.id, lk.id AS a, row_number() OVER (PARTITION BY pk.user_id, pk.id ORDER BY round(weight * s, 9) DESC, pos) AS k FROM pk JOIN co ON co.b = pk.id JOIN lk ON lk.user_id = pk.user_id AND lk.id = co.a) SELECT user_id, id, a AS because FROM c WHERE k = 1"),
    Query("taste_match", taste_match, f"WITH {_LISTS}, {_SINGLE} SELECT user_id, id, greatest(1, least(99, round_even(score / max(score) OVER (PARTITION BY user_id) * 99, 0)))::BIGINT AS match FROM sc"),
    Query("wide_interest_scores", wide, f"WITH {_LISTS}, lk AS (SELECT user_id, id, CASE weight WHEN 1.0 THEN 1.0 WHEN 0.7 THEN 0.7 ELSE 0.1 END * (0.5 + 0.5 * pow(0.5, (count(*) OVER (PARTITION BY user_id) - 1 - pos) / 300.0)) AS st FROM ratings WHERE weight > 0), dg AS (SELECT b, count(*) AS degree FROM co GROUP BY b), ev2 AS (SELECT co.a, co.b, ((0.40 * s + 0.5 * 0.5) / (0.40 + 0.5 * 0.60)) * least(pow(degree / 10.0, -0.3), 1.0) AS e FROM co JOIN dg ON dg.b = co.b), w AS (SELECT lk.user_id, ev2.b AS id, sum(st * e) AS score FROM lk JOIN ev2 ON ev2.a = lk.id GROUP BY ALL) SELECT user_id, id, round(score, 6) AS score FROM w ANTI JOIN lk USING (user_id, id)"),
    Query("disliked_nearness", disliked_nearness, f"WITH {_LISTS}, bo2 AS (SELECT a, b, s FROM co UNION ALL SELECT b, a, s FROM co) SELECT user_id, b AS id, max(s) AS near FROM ratings JOIN bo2 ON bo2.a = ratings.id WHERE weight < 0 GROUP BY ALL"),
    Query("interest_clusters", interest_clusters),
    Query("recommend", recommended),
    Query("study_ranking", study_ranking, f"WITH {SHOWS_SQL}, {FACET_SQL}, {NEAR_SQL}, sd AS (SELECT id, CASE WHEN id % 100 = 0 THEN 1.0 ELSE 0.7 END AS w FROM shows WHERE id % {ASKED} = 0), tw AS (SELECT sum(w) AS norm, max(w) AS top FROM sd) SELECT b AS id, round(least(1.0, 0.7 * sum(w / norm * near) + 0.3 * max(w / top * near)), 6) AS score FROM near JOIN sd ON sd.id = near.a, tw WHERE b % {ASKED} <> 0 GROUP BY b"),
    Query("sensitivity_ranks", sensitivity_ranks, f"{_PARTS} SELECT id, variant, score, rank FROM rr"),
    Query("sensitivity_overlap", sensitivity_overlap, f"{_PARTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY rank, id) AS k FROM rr) WHERE k <= 20) SELECT variant, count(*) FILTER (id IN (SELECT id FROM f WHERE variant = 'base')) AS shared FROM f GROUP BY variant"),
    Query("correlation_pairs", correlation_pairs, f"WITH {SHOWS_SQL}, p AS (SELECT 'popularity' AS a, 'rating' AS b, popularity::DOUBLE AS x, rating::DOUBLE AS y FROM shows UNION ALL SELECT 'popularity', 'runtime', popularity, runtime FROM shows UNION ALL SELECT 'rating', 'runtime', rating, runtime FROM shows), k AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM k) SELECT a, b, round(corr(rx, ry), 6) AS rho FROM r GROUP BY a, b"),
    Query("competition_place", competition, f"WITH {SHOWS_SQL} SELECT id, row_number() OVER (PARTITION BY type ORDER BY popularity DESC, id) AS place FROM shows"),
    Query("spread_rank", spread_rank, f"{_RK}, m AS (SELECT *, round(ln(rank) - ln(0.75 * pow(0.5, row_number() OVER (PARTITION BY type, network ORDER BY rank) - 1) + 0.25), 9) AS m FROM rk) SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY m, rank, id) AS place FROM m"),
    Query("dither", dithered, f"{_RK}, p AS (SELECT *, round(ln(rank) + 0.35 * ln(1 + id % 3), 9) AS st FROM rk WHERE rank <= 72), s AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY st, rank) AS s FROM p), o AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN s <= 5 THEN s END ASC NULLS LAST, CASE WHEN s > 5 THEN round(st + 0.35 * {_G('dither')}, 9) END, id) AS place FROM s) SELECT * FROM o WHERE place <= 24"),
    Query("rotate", rotated, f"{_RK}, p AS (SELECT *, round(ln(rank) + 0.35 * ln(1 + id % 3), 9) AS st FROM rk), s AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY st, rank) AS s FROM p), o AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY round(2.5 * st - {_G('rotate')}, 9), id) AS place FROM s WHERE s <= 10) SELECT * FROM o WHERE place <= 2"),
    Query("pick_one", drawn, f"{_RK}, n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id % 4 = 0, rank) AS n FROM rk), o AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY round(-ln(n) + {_G('draw')}, 9) DESC, n) AS k FROM n WHERE (id % 4 <> 0 OR n = 1) AND n <= 10) SELECT type, id FROM o WHERE k = 1"),
    Query("explore_insertion", explored, f"{_RK}, ch AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY {_U.format('explore')}, id) AS n FROM rk WHERE rank BETWEEN 25 AND 72 AND popularity >= 0.75 * (SELECT z.popularity FROM rk z WHERE z.type = rk.type AND z.rank = 24)), le AS (SELECT type, max(rank) AS len FROM rk WHERE rank <= 24 GROUP BY type), nw AS (SELECT ch.type, id, CASE n WHEN 1 THEN 12 ELSE 20 END AS place FROM ch JOIN le ON le.type = ch.type WHERE n <= 2 AND CASE n WHEN 1 THEN 12 ELSE 20 END <= len), tk AS (SELECT rk.type, id, rank, (SELECT count(*) FROM nw WHERE nw.type = rk.type AND nw.place = 12) AS t1, (SELECT count(*) FROM nw WHERE nw.type = rk.type AND nw.place = 20) AS t2 FROM rk WHERE rank <= 24), m AS (SELECT type, id, rank + CASE WHEN t1 > 0 AND rank >= 12 THEN 1 ELSE 0 END AS p1, t2 FROM tk), mv AS (SELECT type, id, p1 + CASE WHEN t2 > 0 AND p1 >= 20 THEN 1 ELSE 0 END AS place, false AS different FROM m UNION ALL SELECT type, id, place, true FROM nw) SELECT mv.type, id, place, different FROM mv JOIN le ON le.type = mv.type WHERE place <= len"),
    Query("shuffle_rows", shuffled_rows, f"{_RK} SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN rank <= 2 THEN 0 ELSE 1 END, CASE WHEN rank <= 2 THEN rank END, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END, round(ln(rank) + 0.3 * {_G('rows')}, 9), id) AS place FROM rk WHERE rank <= 12"),
    Query("softmax_draw", softmax_draws, f"WITH {SHOWS_SQL}, k AS (SELECT type, id, popularity / 100 AS score, row_number() OVER (PARTITION BY type ORDER BY popularity DESC, id) AS k FROM shows), o AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY round(score / 0.1 + {_G('starter')}, 9) DESC, k) AS p FROM k WHERE k <= 5) SELECT type, id FROM o WHERE p = 1"),
    Query("default_row_order", default_order, f"WITH {SHOWS_SQL}, b AS (SELECT type, id, round(0.65 * coalesce(1 - (row_number() OVER (PARTITION BY type ORDER BY genre_bits DESC, id) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY type) - 1, 0), 1.0) + 0.2 * (popularity / 100) + 0.15 * (coalesce(rating, 5.0) / 10), 9) AS blend FROM shows) SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY blend DESC, id) AS place FROM b"),
    Query("row_relevance", relevance, f"{_RK} SELECT type, round(0.8 * sum(popularity / 100 / log2(rank + 1)) / sum(1 / log2(rank + 1)), 6) AS relevance FROM rk WHERE rank <= 30 GROUP BY type"),
    Query("hidden_gems", hidden_gems, f"WITH {SHOWS_SQL}, r AS (SELECT type, rating, row_number() OVER (PARTITION BY type ORDER BY rating) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM shows WHERE rating IS NOT NULL), q AS (SELECT type, rating AS q75 FROM r WHERE i = floor(0.75 * (n - 1))), g AS (SELECT s.type, id, round(0.6 * ((id * 31 % 101) / 100) + 0.4 * (rating / 10), 9) AS worth FROM shows s JOIN q ON q.type = s.type WHERE popularity / 100 <= 0.4 AND rating >= q75 AND (id * 31 % 101) / 100 >= 0.8) SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY worth DESC, id) AS place FROM g"),
    Query("browse_rows", browse_rows, f"WITH {SHOWS_SQL}, g AS (SELECT id, unnest(list_distinct(string_split(name, ' '))) AS genre, popularity, rating, year FROM shows) SELECT * FROM (" + " UNION ALL ".join(f"SELECT genre, '{k}' AS row, row_number() OVER (PARTITION BY genre ORDER BY {o}, id) AS place, id FROM g" for k, o in _BROWSE.items()) + ") WHERE place <= 20"),
    Query("row_kinds", tagged_rows, f"WITH {SHOWS_SQL} SELECT * FROM (SELECT 'acclaimed' AS row, row_number() OVER (ORDER BY rating DESC, popularity DESC, id) AS place, id FROM shows WHERE rating >= 8.5 UNION ALL SELECT 'gems', row_number() OVER (ORDER BY rating DESC NULLS LAST, id), id FROM shows WHERE popularity < 40 UNION ALL SELECT 'decade', row_number() OVER (ORDER BY popularity DESC, id), id FROM shows WHERE year BETWEEN 1990 AND 1999) WHERE place <= 15"),
    Query("row_titles", row_titles, f"WITH {SHOWS_SQL}, t AS (SELECT id, concat_ws(' ', CASE WHEN rating > 9 THEN 'acclaimed' END, lower(language), string_split(name, ' ')[2], 'series', CASE WHEN year >= 1990 THEN 'from the ' || (year // 10 * 10) || 's' END) AS t FROM shows) SELECT id, upper(t[1]) || t[2:] AS title FROM t"),
    Query("starter_scores", starter_scores),
    Query("row_recipes", row_recipes, f"""WITH {SHOWS_SQL}, {RATINGS_SQL},
p AS (SELECT id, string_split(name, ' ')[2] || 's' AS core, lower(type) AS form, language AS place, string_split(name, ' ')[1] AS adjective, (year // 10 * 10)::VARCHAR || 's' AS era FROM shows),
b AS (SELECT unnest(range(16)) AS mask),
x AS (SELECT DISTINCT id, core, CASE WHEN mask & 1 > 0 THEN form END AS form, CASE WHEN mask & 2 > 0 THEN place END AS place, CASE WHEN mask & 4 > 0 THEN adjective END AS adjective, CASE WHEN mask & 8 > 0 THEN era END AS era FROM p, b),
c AS (SELECT core, form, place, adjective, era, count(*) AS shows FROM x GROUP BY ALL),
l AS (SELECT DISTINCT user_id AS interest, id FROM ratings WHERE weight > 0 AND id IN (SELECT id FROM shows)),
n AS (SELECT interest, count(*) AS members FROM l GROUP BY interest),
f AS (SELECT interest, core, form, place, adjective, era, count(*) AS support FROM l JOIN x USING (id) GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT f.*, shows, (support / members) / (shows / (SELECT count(*) FROM shows)) AS lift,
  array_to_string(list_filter([f.adjective, f.place, f.core, coalesce(f.form, 'shows'), 'from the ' || f.era], lambda w: w IS NOT NULL), ' ') AS name FROM f JOIN n USING (interest)
  JOIN c ON c.core = f.core AND c.form IS NOT DISTINCT FROM f.form AND c.place IS NOT DISTINCT FROM f.place AND c.adjective IS NOT DISTINCT FROM f.adjective AND c.era IS NOT DISTINCT FROM f.era WHERE shows >= 8),
k AS (SELECT interest, upper(name[1]) || name[2:] AS name, support, shows, lift, round(support * ln(lift), 9) AS strength FROM j WHERE lift >= 1.5 - 1e-9 AND len(string_split(replace(name, ' from the ', ' '), ' ')) <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY interest ORDER BY strength DESC, name) AS place FROM k)
SELECT interest, place, name, support, shows, round(lift, 6) AS lift FROM r WHERE place <= 6"""),
    Query("arrange_rows", arrange_rows),
    Query("deduplicated_cards", deduplicated_cards),
    Query("calibrated_row", calibrated),
    Query("home_page_scores", page_scores, "SELECT l_suppkey, max((l_returnflag = 'R' AND l_linenumber - 1 < 3)::INT)::BIGINT AS first_3, max((l_returnflag = 'R' AND l_linenumber - 1 < 8)::INT)::BIGINT AS first_8, max((l_returnflag = 'R')::INT)::BIGINT AS anywhere, count(DISTINCT l_partkey) AS distinct_cards, count(*) - count(DISTINCT l_partkey) AS repeats, count(DISTINCT l_linenumber) AS rows FROM lineitem GROUP BY l_suppkey"),
]
