"""Rating lists: profiles, taste, and what a browser shows of a list. Scores of whole catalogues are for the users whose
id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import accounts, aggregates, client, evaluate, rows, taste
from ..plans.stand_ins import ATTRIBUTES_SQL, RATINGS_SQL, SHOWS_SQL, attributes, ratings, shows
from ..sources.tables import table
from . import Query

ASKED = 50
_LISTS = f"{SHOWS_SQL}, {RATINGS_SQL}"

BASE_SQL = """
ref AS (SELECT id FROM shows WHERE recommendable AND popularity >= 40),
kn AS (SELECT family, count(DISTINCT id) AS known FROM attributes SEMI JOIN ref USING (id) GROUP BY family),
cn AS (SELECT family, value, count(*) AS c FROM attributes SEMI JOIN ref USING (id) GROUP BY ALL),
base AS (SELECT v.family, v.value, greatest(coalesce(c, 0), 0.5)::DOUBLE / coalesce(known, 1) AS base FROM (SELECT DISTINCT family, value FROM attributes) v LEFT JOIN cn USING (family, value) LEFT JOIN kn ON kn.family = v.family)"""
RATIO_SQL = """
rd AS (SELECT r.user_id, r.id, r.weight, a.family, a.value FROM ratings r JOIN attributes a ON a.id = r.id WHERE weight <> 0),
sn AS (SELECT user_id, family, value, sum(CASE WHEN weight > 0 THEN weight ELSE 0.0 END)::DOUBLE AS mass, count(*) FILTER (weight < 0) AS bad, count(*) FILTER (weight > 0) AS support FROM rd GROUP BY ALL),
tt AS (SELECT user_id, family, sum(CASE WHEN weight > 0 THEN weight ELSE 0.0 END)::DOUBLE AS total, count(*) FILTER (weight < 0) AS bad_total FROM (SELECT DISTINCT user_id, family, id, weight FROM rd) GROUP BY ALL),
rat AS (SELECT sn.*, total, bad_total, base, ln((mass + 12 * base) / (total + 12) / base) - 0.5 * ln((bad + 12 * base) / (bad_total + 12) / base) AS ratio
        FROM sn JOIN tt ON tt.user_id = sn.user_id AND tt.family = sn.family JOIN base ON base.family = sn.family AND base.value = sn.value)"""
_FAM = {"language": (1.0, 2.0), "format": (1.0, 2.0), "network": (0.4, 1.5), "decade": (0.5, 1.5), "length": (0.4, 1.0), "fame": (0.8, 1.5), "acclaim": (0.5, 1.0)}
_W = "CASE family " + " ".join(f"WHEN '{f}' THEN {w}" for f, (w, _) in _FAM.items()) + " END"
_L = "CASE family " + " ".join(f"WHEN '{f}' THEN {c}" for f, (_, c) in _FAM.items()) + " END"
CONTRIBUTION_SQL = f"""
ty AS (SELECT user_id, family, ln(12 / (any_value(total) + 12)) - 0.5 * ln(12 / (any_value(bad_total) + 12)) AS unseen, sum(base * ratio) AS s, sum(base) AS b FROM rat GROUP BY ALL),
ev0 AS (SELECT ty.user_id, ty.family, base.value, coalesce(rat.ratio, ty.unseen) - (ty.s + (1 - ty.b) * ty.unseen) AS raw FROM ty JOIN base ON base.family = ty.family LEFT JOIN rat ON rat.user_id = ty.user_id AND rat.family = ty.family AND rat.value = base.value),
con AS (SELECT user_id, family, value, {_W} * greatest(-({_L}), least({_L}, raw)) AS contribution FROM ev0)"""
_TASTE = f"{_LISTS}, {ATTRIBUTES_SQL}, {BASE_SQL}, {RATIO_SQL}"


def reference(spark: SparkSession, d: str) -> DataFrame:
    return shows(spark, d).where("recommendable and popularity >= 40").select("id")


def base(spark: SparkSession, d: str) -> DataFrame:
    return taste.base_rates(attributes(shows(spark, d)), reference(spark, d))


def ratios(spark: SparkSession, d: str) -> DataFrame:
    return taste.list_ratios(ratings(spark, d), attributes(shows(spark, d)), base(spark, d))


def contributions(spark: SparkSession, d: str) -> DataFrame:
    return taste.categorical_contributions(ratios(spark, d), base(spark, d))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every show for every asked user: a product with a stated query set."""
    users = ratings(spark, d).where(f"user_id % {ASKED} = 0").select("user_id").distinct()
    return shows(spark, d).select("id").crossJoin(users)


def genres(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("genre").alias("family"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("value"))


# ------------------------------------------------------------------ queries


def profile_latest_weight(spark, d):
    return ratings(spark, d).select("user_id", "id", "weight", "pos")


def recency_fading(spark, d):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("user_id"))
    return ratings(spark, d).select("user_id", "id", F.round(dates.faded(F.col("pos"), n), 6).alias("fade"))


def base_rates(spark, d):
    return base(spark, d).withColumn("base", F.round("base", 6))


def set_base_rates(spark, d):
    return taste.set_base_rates(genres(spark, d), reference(spark, d)).withColumn("base", F.round("base", 6))


def taste_log_ratio(spark, d):
    return ratios(spark, d).select("user_id", "family", "value", F.round("mass", 6).alias("mass"), "bad", "support", F.round("ratio", 6).alias("ratio"))


def taste_contributions(spark, d):
    return contributions(spark, d).withColumn("contribution", F.round("contribution", 6))


def taste_factor(spark, d):
    scores = taste.taste_score(taste.categorical_scores(candidates(spark, d), attributes(shows(spark, d)), contributions(spark, d)))
    return scores.join(shows(spark, d).select("id", "rating"), "id").select("user_id", "id", F.round("taste", 6).alias("taste"), F.round(taste.factor(F.col("taste"), F.col("rating")), 6).alias("factor"))


def taste_sets(spark, d):
    g = genres(spark, d)
    deltas, offsets = taste.set_deltas(ratings(spark, d), g, taste.set_base_rates(g, reference(spark, d)))
    return taste.set_scores(candidates(spark, d), g, deltas, offsets).withColumn("contribution", F.round("contribution", 6))


def taste_leans(spark, d):
    return taste.leans(ratios(spark, d)).select("user_id", F.col("place").cast("long").alias("place"), "family", "value", "support", F.round("strength", 6).alias("strength"))


def taste_avoids(spark, d):
    return taste.avoids(ratios(spark, d)).withColumn("place", F.col("place").cast("long"))


def taste_reasons(spark, d):
    return taste.reasons(contributions(spark, d), attributes(shows(spark, d)), base(spark, d), candidates(spark, d)).withColumn("place", F.col("place").cast("long"))


def insights_chart(spark, d):
    out = rows.insights(ratings(spark, d), attributes(shows(spark, d)), reference(spark, d))
    mine, theirs = F.round("mine", 9), F.round("theirs", 9)
    return out.select("user_id", "family", "value", mine.alias("mine"), theirs.alias("theirs"), client.compared(mine, theirs).alias("said"))


def radar_rows(spark, d):
    rated = ratings(spark, d).where("weight > 0").join(shows(spark, d), "id").select("user_id", "weight", F.when(F.col("language").isNotNull(), (F.col("language") == "English").cast("int")).alias("english"), F.when(F.col("rating").isNotNull(), (F.col("rating") >= 7.5).cast("int")).alias("acclaimed"))
    out = client.radar(rated, "user_id", ["english", "acclaimed"])
    return out.select("user_id", "dimension", F.round("share", 6).alias("share"), F.round("known", 6).alias("known"))


def spoke_choice(spark, d):
    """Each user's shares beside those of two titles, 7 and 8. Weights are whole twentieths, so the shares are exact."""
    tags = attributes(shows(spark, d)).select("id", "family", F.col("value").alias("name")).where("family <> 'decade'")
    liked = ratings(spark, d).where("weight > 0").select("user_id", "id", F.round(F.col("weight") * 20).cast("long").alias("w"))
    total = liked.groupBy("user_id").agg(F.sum("w").alias("total"))
    mine = liked.join(tags, "id").groupBy("user_id", "name").agg(F.sum("w").alias("w")).join(total, "user_id").select("user_id", "name", F.expr("100 * w div total").alias("you"))
    has = lambda k, c: tags.where(F.col("id") == k).select("name", F.lit(100).cast("long").alias(c))
    every = mine.select("user_id").distinct().crossJoin(F.broadcast(has(7, "them").select("name").union(has(8, "vs").select("name")).distinct()))  # a title has one value a family
    rows_ = mine.join(every, ["user_id", "name"], "full").join(F.broadcast(has(7, "them")), "name", "left").join(F.broadcast(has(8, "vs")), "name", "left")
    return client.spokes(rows_, "user_id", "name").select("user_id", "name", "you", "them", "vs", F.col("place").cast("long").alias("place"))


def similar_choice(spark, d):
    r = ratings(spark, d)
    return client.similar_choice(r.where("id < 50").select("user_id", "id"), r.where("weight > 0")).select("user_id", "id", F.col("place").cast("long").alias("place"))


def last_shown(spark, d):
    from ..plans.stand_ins import item_events

    e = item_events(spark, d).select("user_id", F.col("item").alias("id"), F.to_date("ts").alias("day"))
    out = client.last_shown(e, ratings(spark, d).where("weight = 1"), F.lit("2024-01-20").cast("date"))
    return out.select("user_id", "day", F.col("days_ago").cast("long").alias("days_ago"))


def recent_searches(spark, d):
    e = table(spark, d, "events").select("user_id", F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), F.get_json_object("props", "$.k")).alias("text"), "event_id")
    return client.recent_searches(e, "user_id", "text", "event_id").withColumn("place", F.col("place").cast("long"))


def crew_groups(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    out = client.crew(o, "o_custkey", "o_orderpriority", "o_orderstatus", ["1-URGENT", "5-LOW", "2-HIGH"])
    return out.select("o_custkey", "o_orderpriority", F.array_join("people", ",").alias("people"), F.col("place").cast("long").alias("place"))


def links_once(spark, d):
    return client.links_once(table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^(\w+://[^/]*).*$", "$1").alias("host"), "url"), "host", "url", ["page_id"])


def trailer_rank(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key"), F.when(F.col("l_returnflag") == "A", "Trailer").otherwise("Clip").alias("kind"), (F.col("l_linestatus") == "O").alias("official"), F.col("l_shipdate").alias("published"))
    return client.trailers(v, "l_orderkey").select("l_orderkey", "key", F.col("place").cast("long").alias("place"))


def carried_records(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return client.carried(o, table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "o_orderdate", F.lit("2001-08-01").cast("date")).select("o_orderkey", "c_custkey")


def warm_list(spark, d):
    from ..plans.stand_ins import item_events

    s = shows(spark, d)
    recent = item_events(spark, d).where("ts >= '2024-01-30'").select(F.col("item").alias("id"))
    return client.warm_list(recent, s, s.where("status = 'Ended'"), "id")


def visit_merge(spark, d):
    from ..operators.sets import ordered_union

    r = ratings(spark, d)
    out = ordered_union([r.where("weight = 1").select("user_id", "id", "pos"), r.select("user_id", "id", "pos")], ["user_id"], "id", "pos", 30)
    return out.withColumn("place", F.col("place").cast("long"))


def starter_merge(spark, d):
    r = ratings(spark, d)
    current = r.where("pos < 20").select("user_id", (F.col("pos") + 1).cast("int").alias("place"), "id", (F.col("weight") == 1).alias("picked"))
    incoming = r.select("user_id", (-F.col("pos")).alias("place"), "id")
    return rows.positional_merge(current, incoming).select("user_id", F.col("place").cast("long").alias("place"), "id")


def known_for(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "R", "regular").when(F.col("l_returnflag") == "A", "created").otherwise("guest").alias("kind"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("string").alias("title"))
    return rows.known_for(li, "l_suppkey").withColumn("place", F.col("place").cast("long"))


def regular_share(spark, d):
    out = rows.regular_share(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", "l_orderkey", "l_linenumber", 4)
    return out.withColumn("share", F.round("share", 6))


def guest_credits(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year"))
    out = aggregates.credits(li, ["l_suppkey"], "l_returnflag", "year")
    return out.select("l_suppkey", "episodes", F.col("first_year").cast("long").alias("first_year"), F.col("last_year").cast("long").alias("last_year"), F.array_join("characters", ",").alias("characters"))


def poster_colours(spark, d):
    px = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") * 7.2).alias("hue"), F.col("l_discount").alias("weight"))
    return rows.poster_colour(px, "l_suppkey", dull=0.01).withColumn("hue", F.round("hue", 4))


def alias_rank(spark, d):
    a = table(spark, d, "documents").select("source", F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("language"), F.lit("fr").alias("own")).where("name is not null")
    return rows.ranked_aliases(a, "source").withColumn("place", F.col("place").cast("long"))


def alias_quota(spark, d):
    from ..operators.sets import quota

    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    return quota(docs, ["source"], "lang", [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", F.col("place").cast("long").alias("place"))


def leave_one_out(spark, d):
    folds = evaluate.leave_one_out(ratings(spark, d))
    return folds.groupBy("user_id", "fold").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def few_shots(spark, d):
    return evaluate.few_shots(ratings(spark, d), "bench").withColumn("draw", F.col("draw").cast("long"))


def preference_compaction(spark, d):
    from ..plans.stand_ins import item_events

    e = item_events(spark, d).select("user_id", F.col("item").alias("id"), "weight", "event_id")
    return accounts.compacted(e, "user_id", "id", "weight", "event_id").withColumn("place", F.col("place").cast("long"))


def removals_since(spark, d):
    t = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").cast("long").alias("revision"))
    return accounts.removals_since(t, 1998).withColumn("place", F.col("place").cast("long"))


def _save(spark, d):
    o = table(spark, d, "orders")
    stored = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"), (F.col("o_custkey") % 5).alias("revision"))
    changes = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), (F.col("o_custkey") % 3).alias("base"))
    return accounts.optimistic_save(stored, changes)


def optimistic_save(spark, d):
    return _save(spark, d)[0]


def save_tombstones(spark, d):
    return _save(spark, d)[1]


def save_refused(spark, d):
    return _save(spark, d)[2]


def guest_import(spark, d):
    from ..operators.joins import import_guest

    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    part = lambda s: o.where(f"o_orderstatus = '{s}'").select("o_custkey", "o_orderpriority").distinct()
    return import_guest(part("F"), part("O"), part("P"), ["o_custkey", "o_orderpriority"])


def expired_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("ended"))
    return accounts.expired(o, "o_orderdate", F.lit("2001-06-01").cast("date"), "ended").select("o_orderkey")


def pending_ids(spark, d):
    return accounts.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


_NAMED = f"SELECT c.user_id, a.id, c.family, c.value, round(c.contribution, 9) AS c FROM con c JOIN attributes a ON a.family = c.family AND a.value = c.value JOIN base ON base.family = c.family AND base.value = c.value WHERE c.user_id % {ASKED} = 0 AND contribution > 0.15 AND base < 0.3 AND c.family NOT IN ('fame', 'acclaim')"
_SHARES = "round(mass / total, 9) AS mine, round(coalesce(c, 0) / known, 9) AS theirs"

QUERIES = [
    Query("profile_latest_weight", profile_latest_weight, f"WITH {RATINGS_SQL} SELECT user_id, id, weight, pos FROM ratings"),
    Query("recency_fading", recency_fading, f"WITH {RATINGS_SQL} SELECT user_id, id, round(0.5 + 0.5 * pow(0.5, (count(*) OVER (PARTITION BY user_id) - 1 - pos) / 300.0), 6) AS fade FROM ratings"),
    Query("taste_base_rates", base_rates, f"WITH {SHOWS_SQL}, {ATTRIBUTES_SQL}, {BASE_SQL} SELECT family, value, round(base, 6) AS base FROM base"),
    Query("taste_set_base_rates", set_base_rates, f"WITH {SHOWS_SQL}, g AS (SELECT DISTINCT id, unnest(string_split(name, ' ')) AS value FROM shows), r AS (SELECT id FROM shows WHERE recommendable AND popularity >= 40), n AS (SELECT count(*)::DOUBLE AS n FROM r), c AS (SELECT value, count(*) AS c FROM g SEMI JOIN r USING (id) GROUP BY value) SELECT 'genre' AS family, value, round(least(greatest(coalesce(c, 0) / n, 0.5 / n), 1 - 0.5 / n), 6) AS base FROM (SELECT DISTINCT value FROM g) LEFT JOIN c USING (value), n"),
    Query("taste_log_ratio", taste_log_ratio, f"WITH {_TASTE} SELECT user_id, family, value, round(mass, 6) AS mass, bad, support, round(ratio, 6) AS ratio FROM rat"),
    Query("taste_contributions", taste_contributions, f"WITH {_TASTE}, {CONTRIBUTION_SQL} SELECT user_id, family, value, round(contribution, 6) AS contribution FROM con"),
    Query("taste_factor", taste_factor, f"WITH {_TASTE}, {CONTRIBUTION_SQL}, t AS (SELECT user_id, id, sum(contribution) AS taste FROM con JOIN attributes USING (family, value) WHERE user_id % {ASKED} = 0 GROUP BY ALL) SELECT user_id, id, round(taste, 6) AS taste, round(exp(0.7 * taste + 0.4 * CASE WHEN coalesce(rating, 0) = 0 THEN 0.0 ELSE greatest(-1.5, least(1.5, (rating - 7.2) / 1.2)) END), 6) AS factor FROM t JOIN shows USING (id)"),
    Query("taste_sets", taste_sets),
    Query("taste_leans", taste_leans, f"WITH {_TASTE}, a AS (SELECT *, round(mass / total, 9) AS share, round(round(mass / total, 9) / base, 9) AS lift FROM rat WHERE total > 0 AND family NOT IN ('fame', 'acclaim') AND base < 0.3 AND support >= 2), b AS (SELECT *, lower(string_split(value, ' / ')[1]) AS head, round(share * ln(lift), 9) AS strength FROM a WHERE (share >= 0.25 AND lift >= 1.5) OR (support >= 20 AND share >= 0.1 AND lift >= 2)), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, head ORDER BY strength DESC, family, value) AS k FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, family, value) AS place FROM k WHERE k = 1) SELECT user_id, place, family, value, support, round(strength, 6) AS strength FROM p WHERE place <= 6"),
    Query("taste_avoids", taste_avoids, f"WITH {_TASTE}, a AS (SELECT *, coalesce(mass / nullif(total, 0), 0) AS share FROM rat WHERE family IN ('format', 'language', 'network') AND bad >= 2), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(bad + 1 - share, 9) DESC, family, value) AS place FROM a WHERE share < base AND bad / bad_total >= 0.5) SELECT user_id, place, family, value, bad FROM p WHERE place <= 6"),
    Query("taste_reasons", taste_reasons, f"WITH {_TASTE}, {CONTRIBUTION_SQL}, n AS ({_NAMED}), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, id, lower(string_split(value, ' / ')[1]) ORDER BY c DESC, family) AS k FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY c DESC, family, value) AS place FROM k WHERE k = 1) SELECT user_id, id, place, family, value FROM p WHERE place <= 3"),
    Query("insights_chart", insights_chart, f"WITH {_LISTS}, {ATTRIBUTES_SQL}, ref AS (SELECT id FROM shows WHERE recommendable AND popularity >= 40), n AS (SELECT family, count(DISTINCT id) AS known FROM attributes SEMI JOIN ref USING (id) GROUP BY family), c AS (SELECT family, value, count(DISTINCT id) AS c FROM attributes SEMI JOIN ref USING (id) GROUP BY ALL), l AS (SELECT r.user_id, r.id, r.weight, a.family, a.value FROM ratings r JOIN attributes a ON a.id = r.id WHERE weight > 0), t AS (SELECT user_id, family, sum(weight) AS total FROM (SELECT DISTINCT user_id, id, family, weight FROM l) GROUP BY ALL), m AS (SELECT user_id, family, value, sum(weight) AS mass FROM l GROUP BY ALL), s AS (SELECT m.user_id, m.family, m.value, {_SHARES} FROM m JOIN t ON t.user_id = m.user_id AND t.family = m.family LEFT JOIN n ON n.family = m.family LEFT JOIN c ON c.family = m.family AND c.value = m.value) SELECT *, CASE WHEN mine - theirs > 0.005 THEN 'more often' WHEN theirs - mine > 0.005 THEN 'less often' ELSE 'about as often' END AS said FROM s"),
    Query("radar_rows", radar_rows, f"WITH {_LISTS}, j AS (SELECT user_id, weight, CASE WHEN language IS NOT NULL THEN (language = 'English')::INT END AS e, CASE WHEN rating IS NOT NULL THEN (rating >= 7.5)::INT END AS c FROM ratings JOIN shows USING (id) WHERE weight > 0), l AS (SELECT user_id, 'english' AS dimension, weight AS w, e AS v FROM j UNION ALL SELECT user_id, 'acclaimed', weight, c FROM j) SELECT user_id, dimension, round(sum(w * v) / sum(w) FILTER (v IS NOT NULL), 6) AS share, round(coalesce(sum(w) FILTER (v IS NOT NULL), 0) / sum(w), 6) AS known FROM l GROUP BY ALL"),
    Query("spoke_choice", spoke_choice, f"WITH {_LISTS}, {ATTRIBUTES_SQL}, tg AS (SELECT id, value AS name FROM attributes WHERE family <> 'decade'), lk AS (SELECT user_id, id, round(weight * 20)::BIGINT AS w FROM ratings WHERE weight > 0), tt AS (SELECT user_id, sum(w)::BIGINT AS total FROM lk GROUP BY user_id), mi AS (SELECT lk.user_id, name, 100 * sum(w)::BIGINT // any_value(total) AS you FROM lk JOIN tg ON tg.id = lk.id JOIN tt ON tt.user_id = lk.user_id GROUP BY ALL), nm AS (SELECT DISTINCT name FROM tg WHERE id IN (7, 8)), al AS (SELECT user_id, name FROM mi UNION SELECT user_id, name FROM (SELECT DISTINCT user_id FROM mi), nm), r AS (SELECT al.user_id, al.name, you, CASE WHEN al.name IN (SELECT name FROM tg WHERE id = 7) THEN 100 END::BIGINT AS them, CASE WHEN al.name IN (SELECT name FROM tg WHERE id = 8) THEN 100 END::BIGINT AS vs FROM al LEFT JOIN mi ON mi.user_id = al.user_id AND mi.name = al.name), s AS (SELECT *, CASE WHEN them > 0 AND coalesce(you, 0) >= 25 THEN 400 ELSE 0 END + CASE WHEN them > 0 THEN 200 ELSE 0 END + CASE WHEN vs = 100 THEN 150 ELSE 0 END + coalesce(you, 0) AS rk FROM r WHERE coalesce(you, 0) + coalesce(them, 0) + coalesce(vs, 0) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(string_split(name, ' / ')[1]) ORDER BY rk DESC, name) AS k FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rk DESC, name) AS place FROM k WHERE k = 1) SELECT user_id, name, you, them, vs, place FROM p WHERE place <= 8"),
    Query("similar_choice", similar_choice, f"WITH {RATINGS_SQL}, k AS (SELECT user_id, id, pos, count(*) OVER (PARTITION BY user_id) AS n FROM ratings WHERE weight > 0 AND id < 50) SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM k WHERE n >= 2"),
    Query("last_shown", last_shown, f"WITH {RATINGS_SQL}, p AS (SELECT e.user_id, max(CAST(e.ts AS DATE)) AS day FROM ev e SEMI JOIN (SELECT user_id, id AS item FROM ratings WHERE weight = 1) r USING (user_id, item) WHERE CAST(e.ts AS DATE) < DATE '2024-01-20' GROUP BY e.user_id) SELECT user_id, day, date_diff('day', day, DATE '2024-01-20') AS days_ago FROM p"),
    Query("recent_searches", recent_searches, "WITH e AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' ' || json_extract_string(props, '$.k') AS text, event_id FROM events), g AS (SELECT user_id, lower(text) AS low, arg_max(text, event_id) AS text, max(event_id) AS event_id FROM e GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, low) AS place FROM g) SELECT user_id, text, event_id, place FROM p WHERE place <= 10"),
    Query("crew_groups", crew_groups, "WITH g AS (SELECT o_custkey, o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS people FROM orders GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderpriority) AS place FROM g"),
    Query("links_once", links_once, r"WITH h AS (SELECT page_id, regexp_replace(url, '^(\w+://[^/]*).*$', '\1') AS host, url FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY host, regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS k FROM h) SELECT page_id, host, url FROM k WHERE k = 1"),
    Query("trailer_rank", trailer_rank, "WITH v AS (SELECT l_orderkey, l_partkey AS key, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS k1, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS k2, l_shipdate AS d FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, key ORDER BY k1, k2, d DESC) AS k FROM v), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k1, k2, d DESC, key) AS place FROM k WHERE k = 1) SELECT l_orderkey, key, place FROM p WHERE place <= 6"),
    Query("carried_records", carried_records, "SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 180 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    Query("warm_list", warm_list, f"WITH {_LISTS} SELECT DISTINCT id FROM (SELECT item AS id FROM ev WHERE ts >= TIMESTAMP '2024-01-30' UNION ALL (SELECT id FROM shows ORDER BY popularity DESC, id LIMIT 200)) WHERE id NOT IN (SELECT id FROM shows WHERE status = 'Ended')"),
    Query("visit_merge", visit_merge, f"WITH {RATINGS_SQL}, p AS (SELECT user_id, id, min(CASE WHEN weight = 1 THEN 0 ELSE 1 END) AS part, min(pos) AS pos FROM ratings GROUP BY ALL), r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY part, pos, id) AS place FROM p) SELECT * FROM r WHERE place <= 30"),
    Query("starter_merge", starter_merge, f"WITH {RATINGS_SQL}, cur AS (SELECT user_id, pos + 1 AS place, id, weight = 1 AS picked FROM ratings WHERE pos < 20), kept AS (SELECT user_id, place, id FROM cur WHERE picked), fr AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS n FROM ratings ANTI JOIN kept USING (user_id, id)), pl AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY place) AS n FROM cur WHERE NOT picked) SELECT user_id, place, id FROM kept UNION ALL SELECT pl.user_id, pl.place, fr.id FROM pl JOIN fr ON fr.user_id = pl.user_id AND fr.n = pl.n"),
    Query("known_for", known_for, "WITH r AS (SELECT l_suppkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS k, CASE l_returnflag WHEN 'R' THEN 'regular' WHEN 'A' THEN 'created' ELSE 'guest' END AS kind, l_orderkey AS o, l_linenumber::VARCHAR AS title FROM lineitem), m AS (SELECT *, min(k) OVER (PARTITION BY l_suppkey) AS least FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, title) AS place FROM m WHERE k = least) SELECT l_suppkey, place, kind, title FROM p WHERE place <= 3"),
    Query("regular_cast_share", regular_share, "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_suppkey, count(*) AS credits, count(*) FILTER (n <= 4) AS regular, round(count(*) FILTER (n <= 4) / count(*), 6) AS share FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_suppkey"),
    Query("guest_credits", guest_credits, "WITH g AS (SELECT l_suppkey, l_returnflag AS f, count(*) AS c, min(year(l_shipdate)) AS y0, max(year(l_shipdate)) AS y1 FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, f) AS k FROM g) SELECT l_suppkey, sum(c)::BIGINT AS episodes, min(y0)::BIGINT AS first_year, max(y1)::BIGINT AS last_year, string_agg(f, ',' ORDER BY k) FILTER (k <= 2) AS characters FROM r GROUP BY l_suppkey"),
    Query("poster_colours", poster_colours),
    Query("alias_rank", alias_rank, "WITH a AS (SELECT DISTINCT source, concat_ws(' ', lang, doc_id::VARCHAR) AS name, lang, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS kind, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS other FROM documents), p AS (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY kind, other, lang NULLS FIRST, name) AS place FROM a) SELECT source, place, name FROM p WHERE place <= 12"),
    Query("alias_quota_rank", alias_quota, "WITH k AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents), p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ceil(k / 2), n_chars DESC, doc_id) AS place FROM k) SELECT * FROM p WHERE place <= 12"),
    Query("leave_one_out", leave_one_out, f"WITH {RATINGS_SQL}, f AS (SELECT user_id, id AS fold FROM ratings WHERE weight >= 0.7) SELECT f.user_id, fold, count(*) AS n, round(sum(weight), 6) AS weight FROM f JOIN ratings r ON r.user_id = f.user_id AND r.id <> fold GROUP BY ALL"),
    Query("few_shots", few_shots, f"WITH {RATINGS_SQL}, m AS (SELECT user_id, id, count(*) OVER (PARTITION BY user_id) AS n FROM ratings WHERE weight > 0), e AS (SELECT user_id, id, unnest(range(1, 6)) AS draw FROM m WHERE n > 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, draw ORDER BY substr(sha256('bench|' || user_id || '|' || draw || '|' || id), 1, 13), id) AS k FROM e) SELECT user_id, draw, id FROM k WHERE k <= 3"),
    Query("preference_compaction", preference_compaction, f"WITH {RATINGS_SQL}, v AS (SELECT user_id, item AS id, arg_min(weight, event_id) AS weight, min(event_id) AS e FROM ev WHERE item > 0 GROUP BY ALL) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY e, id) AS place, id, weight FROM v"),
    Query("removals_since", removals_since, "SELECT o_custkey AS account_id, o_orderkey AS key, year(o_orderdate)::BIGINT AS revision, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) > 1998"),
    Query("optimistic_save", optimistic_save, "WITH st AS (SELECT o_custkey AS a, o_orderkey AS k, o_orderpriority AS v, o_custkey % 5 AS r FROM orders WHERE o_orderstatus <> 'F'), ch AS (SELECT o_custkey AS a, o_orderkey AS k, o_orderstatus AS v, o_custkey % 3 AS b FROM orders WHERE o_orderpriority = '1-URGENT'), ok AS (SELECT q.a, coalesce(r, 0) + 1 AS nr FROM (SELECT a, max(b) AS b FROM ch GROUP BY a) q LEFT JOIN (SELECT a, max(r) AS r FROM st GROUP BY a) s ON s.a = q.a WHERE b = coalesce(r, 0)) SELECT a AS account_id, k AS key, v AS value, r AS revision FROM st WHERE a NOT IN (SELECT a FROM ok) UNION ALL SELECT ch.a, k, v, nr FROM ch JOIN ok ON ok.a = ch.a"),
    Query("save_tombstones", save_tombstones, "WITH st AS (SELECT o_custkey AS a, o_orderkey AS k, o_custkey % 5 AS r FROM orders WHERE o_orderstatus <> 'F'), ch AS (SELECT o_custkey AS a, o_orderkey AS k, o_custkey % 3 AS b FROM orders WHERE o_orderpriority = '1-URGENT'), ok AS (SELECT q.a, coalesce(r, 0) + 1 AS nr FROM (SELECT a, max(b) AS b FROM ch GROUP BY a) q LEFT JOIN (SELECT a, max(r) AS r FROM st GROUP BY a) s ON s.a = q.a WHERE b = coalesce(r, 0)) SELECT st.a AS account_id, st.k AS key, nr AS revision FROM st JOIN ok ON ok.a = st.a ANTI JOIN ch ON ch.a = st.a AND ch.k = st.k"),
    Query("save_refused", save_refused, "WITH st AS (SELECT o_custkey AS a, max(o_custkey % 5) AS r FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), ch AS (SELECT o_custkey AS a, max(o_custkey % 3) AS b FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT ch.a AS account_id, b AS base, coalesce(r, 0) AS revision FROM ch LEFT JOIN st ON st.a = ch.a WHERE b <> coalesce(r, 0)"),
    Query("tombstone_antijoin", guest_import, "WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus AS s FROM orders) SELECT o_custkey, o_orderpriority FROM p WHERE s = 'F' UNION ALL SELECT o_custkey, o_orderpriority FROM p x WHERE s = 'O' AND NOT EXISTS (SELECT 1 FROM p y WHERE y.s IN ('F', 'P') AND y.o_custkey = x.o_custkey AND y.o_orderpriority = x.o_orderpriority)"),
    Query("expired_rows", expired_rows, "SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') > CASE WHEN o_orderstatus = 'F' THEN 30 ELSE 180 END"),
    Query("pending_ids", pending_ids, "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
]
