"""Provider payloads (JSON strings) cut to what is used. A value counts only in the type that it should have: a number where a
text should stand is no text, 3.0 is no whole number. What does not parse, or is of another shape, has no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of days and moments that providers give, and of a video's key.
DAY, STAMP, VIDEO = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$", r"^[A-Za-z0-9_-]{11}$"
#: Age ratings from the mildest on; of equally frequent ones the strictest counts.
AGES = ("TV-Y", "TV-Y7", "TV-G", "TV-PG", "TV-14", "TV-MA")


def _typed(v: Column, path: str, kind: str, target: str) -> Column:
    held = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(held) == kind, F.try_variant_get(v, path, target))


def text_at(v: Column, path: str) -> Column:
    return _typed(v, path, "STRING", "string")


def whole_at(v: Column, path: str) -> Column:
    return _typed(v, path, "BIGINT", "bigint")


def true_at(v: Column, path: str) -> Column:
    return F.coalesce(_typed(v, path, "BOOLEAN", "boolean"), F.lit(False))


def number_at(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def shaped_at(v: Column, path: str, pattern: str) -> Column:
    """The text if it has the form, else an empty one."""
    t = text_at(v, path)
    return F.when(t.rlike(pattern), t).otherwise("")


def score_at(v: Column, path: str) -> Column:
    """A rating above 0 and up to 10, one decimal; else null."""
    n = number_at(v, path)
    return F.when((n > 0) & (n <= 10), F.round(n, 1))


def entries(payloads: DataFrame, key: str, json: str, path: str = "$", first: str | None = None) -> DataFrame:
    """key, at (from 0), entry: the elements of the array at a path; first: the path of an object that comes before them."""
    body = payloads.select(key, F.try_parse_json(json).alias("_body"))
    none = F.array().cast("array<variant>")
    listed = F.coalesce(F.try_variant_get("_body", path, "array<variant>"), none)
    if first:
        one = F.try_variant_get("_body", first, "variant")
        listed = F.concat(F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)).otherwise(none), listed)
    return body.select(key, F.posexplode(listed).alias("at", "entry"))


def episodes(payloads: DataFrame, key: str, json: str) -> DataFrame:
    """An episode list (array of objects) as rows: key, place (by season, number, id), id, season, number, name, runtime,
    rating, airdate, airstamp (empty: unknown). Entries without a name, an id, a season or a number go, of repeated ids the
    first stays; the first entry of an id that is whole counts."""
    e = F.col("entry")
    rows = entries(payloads, key, json).select(
        key, "at", whole_at(e, "$.id").alias("id"), whole_at(e, "$.season").alias("season"), whole_at(e, "$.number").alias("number"), text_at(e, "$.name").alias("name"), whole_at(e, "$.runtime").alias("runtime"),
        score_at(e, "$.rating.average").alias("rating"), shaped_at(e, "$.airdate", DAY).alias("airdate"), shaped_at(e, "$.airstamp", STAMP).alias("airstamp"),
    ).where("name is not null and id <> 0 and season <> 0 and number <> 0")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "id").orderBy("at"))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("season", "number", "id"))).drop("at", "_n")


def videos(payloads: DataFrame, key: str, json: str, most: int = 12) -> DataFrame:
    """key, place, video, title, kind, published of a payload's trailer and videos, the trailer first, each key once, `most` at
    most; kind is the first category that is a text, else Video; published is a day or what else stood there, cut to ten."""
    e = F.col("entry")
    kinds = F.transform(F.coalesce(F.try_variant_get(e, "$.categories", "array<variant>"), F.array().cast("array<variant>")), lambda c: text_at(c, "$"))
    rows = entries(payloads, key, json, "$.videos", "$.trailer").select(
        key, "at", text_at(e, "$.youtube_video_id").alias("video"), F.coalesce(text_at(e, "$.title"), F.lit("")).alias("title"), F.coalesce(F.try_element_at(F.filter(kinds, lambda k: k.isNotNull()), F.lit(1)), F.lit("Video")).alias("kind"),
        F.substring(F.coalesce(text_at(e, "$.published"), F.lit("")), 1, 10).alias("published"),
    ).where(F.col("video").rlike(VIDEO))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "video").orderBy("at"))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("place") <= most).drop("at", "_n")


def store_seasons(payloads: DataFrame, key: str, json: str, stores: Sequence[str]) -> DataFrame:
    """key, at, artist, rating, title, year, link of a store's season listings (results); entries without an artist go, a link
    counts only if it starts with one of the stores' addresses."""
    e = F.col("entry")
    link = text_at(e, "$.collectionViewUrl")
    known = F.lit(False)
    for s in stores:
        known = known | link.startswith(s)
    year = F.regexp_extract(text_at(e, "$.releaseDate"), r"^(\d{4})", 1)
    return entries(payloads, key, json, "$.results").select(
        key, "at", text_at(e, "$.artistName").alias("artist"), text_at(e, "$.contentAdvisoryRating").alias("rating"), F.coalesce(text_at(e, "$.collectionName"), F.lit("")).alias("title"),
        F.nullif(year, F.lit("")).cast("int").alias("year"), F.when(known & link.rlike(r'^https?://[^\s"<>]+$'), link).alias("link"),
    ).where("artist is not null")


def folded(c: Column) -> Column:
    """Lower-case runs of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def store_ratings(seasons: DataFrame, shows: DataFrame, key: str) -> DataFrame:
    """seasons: as store_seasons gives them, of the search for each show; shows: key, name, start, end (years or null). key,
    rating, link: only listings of exactly the name whose year falls within the run (a year around it) lend theirs. The
    commonest age rating counts, ties to the stricter; the link opens the earliest numbered season, else the newest
    listing. Shows without such listings have no row."""
    ages = F.array(*(F.lit(a) for a in AGES))
    run = F.col("year").between(F.coalesce("start", F.lit(0)) - 1, F.coalesce("end", F.lit(9999)) + 1)
    hits = seasons.join(shows.select(key, "name", "start", "end"), key).withColumn("_age", F.array_position(ages, F.col("rating")))
    hits = hits.where((folded(F.col("artist")) == folded(F.col("name"))) & (F.col("_age") > 0) & run)
    by_age = hits.groupBy(key, "rating", "_age").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("rating", F.struct("n", "_age")).alias("rating"))
    start = F.concat(folded(F.col("name")), F.lit(" season "))
    number = F.when(folded(F.col("title")).startswith(start), F.regexp_extract(F.substring(folded(F.col("title")), F.length(start) + 1, F.length("title")), r"^(\d+)$", 1))
    linked = hits.where("link is not null").withColumn("_number", F.nullif(number, F.lit("")).try_cast("bigint"))
    regular = linked.groupBy(key).agg(F.min_by("link", F.when(F.col("_number").isNotNull(), F.struct("_number", "year", "link"))).alias("regular"), F.min_by("link", F.struct(-F.col("year"), "at")).alias("newest"))
    return by_age.join(regular, key, "left").select(key, "rating", F.coalesce("regular", "newest").alias("link"))


def credits(payloads: DataFrame, json: str, most: int = 500) -> DataFrame:
    """Payloads of people as rows of credits: person, kind (cast or crew), place, show, show_name, part (whom they play, or
    their job), self, voice; `most` of each kind. A credit needs a linked show with a number and a name, a crew credit a
    job; a payload without an id or a name has no rows."""
    body = payloads.select(F.try_parse_json(json).alias("b"))
    of = body.select(whole_at(F.col("b"), "$.id").alias("person"), text_at(F.col("b"), "$.name").alias("name"), "b").where("person <> 0 and trim(name) <> ''")
    none, e = F.array().cast("array<variant>"), F.col("entry")
    tidy = lambda c, most: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)
    out = None
    for kind, path, part in (("cast", "$._embedded.castcredits", tidy(F.coalesce(text_at(e, "$._links.character.name"), F.lit("")), 200)), ("crew", "$._embedded.crewcredits", tidy(text_at(e, "$.type"), 60))):
        each = of.select("person", F.posexplode(F.coalesce(F.try_variant_get("b", path, "array<variant>"), none)).alias("at", "entry"))
        rows = each.select(
            "person", F.lit(kind).alias("kind"), "at", F.regexp_extract(text_at(e, "$._links.show.href"), r"/shows/(\d{1,9})$", 1).try_cast("bigint").alias("show"), tidy(text_at(e, "$._links.show.name"), 200).alias("show_name"), part.alias("part"),
            true_at(e, "$.self").alias("self"), true_at(e, "$.voice").alias("voice"),
        ).where("show is not null and show_name <> '' and part is not null").where((F.lit(kind) == "cast") | (F.col("part") != ""))
        out = rows if out is None else out.union(rows)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("person", "kind").orderBy("at"))).where(F.col("place") <= most).drop("at")
