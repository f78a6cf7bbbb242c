"""Column functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, buckets, dates, noise, packed, text
from ..plans.stand_ins import FAMILY_SQL, SHOWS_SQL, shows
from ..sources.tables import table
from . import Query

#: Patterns of the stand-in themes.
THEMES = ("(^|[^a-z])the([^a-z]|$)", "tion", "ing", "[0-9]", "ou", "sch", "que", "ment")


def html_strip_words(spark: SparkSession, d: str) -> DataFrame:
    stripped = text.strip_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(stripped).alias("digest"), F.size(F.filter(F.split(stripped, " "), lambda w: w != "")).cast("long").alias("words"))


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.plain(F.col("html"), 700).alias("summary"), F.length(text.clean_html(F.col("html"))).alias("n_chars"))


def theme_flags(spark: SparkSession, d: str) -> DataFrame:
    mask = bits.pattern_flags(F.col("text"), THEMES)
    return table(spark, d, "documents").select("doc_id", mask.alias("theme_bits"), F.bit_count(mask).cast("long").alias("themes"))


def genre_bits(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    vocabulary = ("red", "blue", "small", "hot", "widget", "gear", "bolt", "ring")
    return table(spark, d, "part").select("p_partkey", bits.encode(words, vocabulary).alias("genre_bits"))


def attribute_buckets(spark: SparkSession, d: str) -> DataFrame:
    s = shows(spark, d)
    return s.select(
        "id", buckets.decade(F.col("year")).alias("decade"), buckets.length(F.col("runtime")).alias("length"), buckets.fame(F.col("popularity")).alias("fame"), buckets.acclaim(F.col("rating")).alias("acclaim"),
        buckets.rating_band(F.col("rating")).alias("band"), buckets.coverage_label(F.col("summary_words"), F.col("genre_bits") > 0).alias("coverage"), buckets.clamp((F.col("rating") - 7.2) / 1.2, 1.5).alias("quality"),
    )


def names_and_codes(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.initcap("p_name"), F.lit(": Part (1999)"))
    return table(spark, d, "part").select(
        "p_partkey", text.slug(name).alias("slug"), text.stem(name).alias("stem"), text.strip_qualifier(name).alias("bare"), text.is_latin(name).alias("latin"),
        buckets.season_code((F.col("p_partkey") % 30).cast("int")).alias("season"), buckets.episode_code((F.col("p_partkey") % 30).cast("int"), F.nullif((F.col("p_partkey") % 7).cast("int"), F.lit(0))).alias("episode"),
        F.element_at(text.number_variants(F.split("p_name", " ")[1]), 2).alias("plural"),
    )


def cut_summaries(spark: SparkSession, d: str) -> DataFrame:
    flat = text.squeeze(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(text.cut_words(flat, 200)).cast("long").alias("cut"), F.length(text.sentence_cut(flat, 200)).cast("long").alias("sentences"))


def own_title_removed(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract(F.lower("text"), "([a-z]{3,})", 1)
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.length(text.remove_title(F.col("text"), title)).cast("long").alias("left"))


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    t, md5 = F.col("text"), lambda c: F.md5(F.coalesce(c, F.lit("")))
    return table(spark, d, "documents").select("doc_id", md5(text.fold_name(t)).alias("folded"), md5(text.ascii_words(t)).alias("ascii"), md5(text.normalize_title(t)).alias("normal"), text.canonical_genre(F.concat(F.lit("TV "), F.col("source"), F.lit(" series"))).alias("genre"))


def packed_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_id")).alias("ids"))
    codes = F.array_join(F.transform("ids", lambda i: (i % 5).cast("string")), "")
    rows = packed.decode_ratings(F.col("ids"), codes)
    back = packed.encode_ratings(rows)
    return e.select("user_id", F.size(rows).cast("long").alias("n"), F.round(F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["weight"]), 6).alias("weight"), (back["weights"] == codes).alias("same"))


def locale_parts(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat_ws("-", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit("Latn")), F.when(F.col("doc_id") % 2 == 0, F.lit("gb")))
    return table(spark, d, "documents").select("doc_id", packed.locale_parts(tag)["language"].alias("language"), packed.locale_parts(tag)["country"].alias("country"))


def seeds_and_days(spark: SparkSession, d: str) -> DataFrame:
    day = dates.viewing_day(F.col("ts"))
    e = table(spark, d, "events")
    return e.select("event_id", day.alias("day"), noise.day_seed(F.col("user_id").cast("string"), F.date_format(day, "yyyy-MM-dd")).alias("seed"), F.round(noise.hash_uniform(F.lit("s"), F.col("event_id").cast("string")), 9).alias("u"))


def noise_draws(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("seed"))
    u = noise.uniform("seed", F.lit("next"), F.col("event_id").cast("string"))
    return e.select("event_id", u.alias("u"), noise.normal("seed", F.lit("next"), F.col("event_id").cast("string")).alias("z"), noise.gumbel(u).alias("g"))


def release_states(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-08-02 12:00:00").cast("timestamp")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'10:00:00"))
    day = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", dates.released(stamp, day, now).alias("released"), dates.age_years(F.to_date("o_orderdate"), F.to_date(now)).cast("long").alias("age"), dates.due(F.col("o_orderdate"), now, F.col("o_orderstatus") == "F").alias("due"))


_STRIP = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_FLAGS = " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {1 << j} ELSE 0 END" for j, p in enumerate(THEMES))

QUERIES = [
    Query("html_strip_words", html_strip_words, f"SELECT page_id, md5({_STRIP}) AS digest, len(list_filter(string_split({_STRIP}, ' '), lambda w: w <> ''))::BIGINT AS words FROM pages"),
    Query("html_clean", html_clean),
    Query("theme_flags_bits", theme_flags, f"SELECT doc_id, ({_FLAGS})::BIGINT AS theme_bits, bit_count(({_FLAGS})::BIGINT)::BIGINT AS themes FROM documents"),
    Query("genre_bits", genre_bits, "SELECT p_partkey, (" + " + ".join(f"CASE WHEN list_contains(string_split(p_name, ' '), '{w}') THEN {1 << j} ELSE 0 END" for j, w in enumerate(("red", "blue", "small", "hot", "widget", "gear", "bolt", "ring"))) + ")::BIGINT AS genre_bits FROM part"),
    Query("attribute_buckets", attribute_buckets, f"""WITH {SHOWS_SQL} SELECT id, {FAMILY_SQL['decade']} AS decade, {FAMILY_SQL['length']} AS length, {FAMILY_SQL['fame']} AS fame, {FAMILY_SQL['acclaim']} AS acclaim,
        CASE WHEN rating IS NULL THEN 'unrated' WHEN rating >= 9.45 THEN 'masterpiece' WHEN rating >= 8.95 THEN 'outstanding' WHEN rating >= 7.95 THEN 'great' WHEN rating >= 6.95 THEN 'good' WHEN rating >= 5.95 THEN 'fair' WHEN rating >= 4.95 THEN 'weak' ELSE 'poor' END AS band,
        CASE WHEN summary_words >= 15 AND genre_bits > 0 THEN 'plot and genres' WHEN summary_words >= 15 THEN 'plot only' WHEN genre_bits > 0 THEN 'genres only' ELSE 'neither' END AS coverage,
        CASE WHEN rating IS NULL THEN NULL ELSE greatest(-1.5, least(1.5, (rating - 7.2) / 1.2)) END AS quality FROM shows"""),
    Query("names_and_codes", names_and_codes, """WITH p AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, string_split(p_name, ' ')[2] AS w, 'S' || lpad((p_partkey % 30)::VARCHAR, 2, '0') AS season, p_partkey % 7 AS e FROM part)
        SELECT p_partkey, replace(p_name, ' ', '-') || '-part-1999' AS slug, name AS stem, name || ': Part' AS bare, true AS latin, season, season || CASE WHEN e = 0 THEN ' special' ELSE 'E' || lpad(e::VARCHAR, 2, '0') END AS episode, w || 's' AS plural FROM p"""),
    Query("cut_summaries", cut_summaries, r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 200) AS h FROM f), c AS (SELECT *, regexp_extract(h, '^(.*)\s\S*$', 1) AS w, regexp_extract(h, '^(.*[.!?])(?:\s.*)?$', 1) AS s FROM h),
        k AS (SELECT *, CASE WHEN length(t) <= 200 THEN length(t) ELSE length(rtrim(CASE WHEN w = '' THEN h ELSE w END)) + 1 END::BIGINT AS cut FROM c) SELECT doc_id, cut, CASE WHEN length(t) <= 200 THEN length(t) WHEN s <> '' THEN length(s) ELSE cut END::BIGINT AS sentences FROM k"""),
    Query("own_title_removed", own_title_removed, r"WITH t AS (SELECT doc_id, text, regexp_extract(lower(text), '([a-z]{3,})', 1) AS title FROM documents) SELECT doc_id, title, length(CASE WHEN title = '' THEN text ELSE trim(regexp_replace(regexp_replace(text, '(?i)\b' || title || '\b', ' ', 'g'), '\s+', ' ', 'g')) END)::BIGINT AS left FROM t"),
    Query("folded_names", folded_names),
    Query("packed_lists", packed_lists, "SELECT user_id, count(*) AS n, round(sum(CASE event_id % 5 WHEN 4 THEN 1.0 WHEN 3 THEN 0.7 WHEN 2 THEN 0.35 WHEN 1 THEN 0.0 ELSE -1.0 END)::DOUBLE, 6) AS weight, true AS same FROM events GROUP BY user_id"),
    Query("locale_parts", locale_parts, "SELECT doc_id, lower(lang) AS language, CASE WHEN doc_id % 2 = 0 THEN 'GB' END AS country FROM documents"),
    Query("seeds_and_days", seeds_and_days, "SELECT event_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, substr(sha256(user_id::VARCHAR || '|' || strftime(ts - INTERVAL 4 HOUR, '%Y-%m-%d')), 1, 16) AS seed, round((('0x' || substr(sha256('s|' || event_id::VARCHAR), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496, 9) AS u FROM events"),
    Query("noise_draws", noise_draws),
    Query("release_states", release_states, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 HOUR <= TIMESTAMP '1998-08-02 12:00:00' WHEN o_orderkey % 5 = 0 THEN NULL WHEN CAST(o_orderdate AS DATE) < DATE '1998-08-02' THEN true WHEN CAST(o_orderdate AS DATE) > DATE '1998-08-02' THEN false END AS released,
        CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-08-02' THEN (1998 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0802' THEN 1 ELSE 0 END)::BIGINT END AS age,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > CASE WHEN o_orderstatus = 'F' THEN 7 ELSE 1 END AS due FROM orders"""),
]
