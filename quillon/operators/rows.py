"""Rows of a home or title page: candidate rows by kind, what is like a show, and browsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import percent_similar


def competition_place(scored: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """1 + how many are better + how many tie with a smaller key."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))


def more_like(near: DataFrame, siblings: DataFrame, factors: DataFrame, boost: float = 1.5, reader: float = 0.1, floor: float = 0.25, most: int = 12, most_siblings: int = 6, places: int = 9) -> DataFrame:
    """near: a, b, near, bonus. What is most like each a: reader links count a tenth, siblings (a, b) are lifted, taste
    factors (b, factor) multiply; a show stays if it reaches `floor` of the third best. At most `most`, of them at most
    `most_siblings` siblings. place, percent."""
    s = near.join(siblings.select("a", "b", F.lit(True).alias("sibling")), ["a", "b"], "left").join(factors, "b", "left")
    sibling = F.coalesce("sibling", F.lit(False))
    score = (F.col("near") + reader * F.coalesce("bonus", F.lit(0.0))) * F.when(sibling, boost).otherwise(1.0) * F.coalesce("factor", F.lit(1.0))
    s = s.select("a", "b", sibling.alias("sibling"), F.round(score, places).alias("score")).where("score > 0")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    third = F.coalesce(F.nth_value("score", 3).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    s = s.withColumn("bar", floor * third).where("score >= bar")
    rank = F.row_number().over(Window.partitionBy("a", "sibling").orderBy(F.desc("score"), "b"))
    s = s.withColumn("k", rank).where(~F.col("sibling") | (F.col("k") <= most_siblings))
    return s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("a", "b", "place", "sibling", "score", percent_similar(F.col("score")).alias("percent"))


def fans_like(edges: DataFrame, shows: DataFrame, least: int = 4, most: int = 20) -> DataFrame:
    """edges: a, b, s; shows: id, factual. What readers of a also look at, of the same class; rows of too few go."""
    known = edges.join(shows.select(F.col("id").alias("a"), F.col("factual").alias("fa")), "a").join(shows.select(F.col("id").alias("b"), F.col("factual").alias("fb")), "b").where("fa = fb")
    ranked = known.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("place") <= most)
    return ranked.withColumn("n", F.count("*").over(Window.partitionBy("a"))).where(F.col("n") >= least).select("a", "b", "place")


def hidden_gems(scored: DataFrame, group: str, known_most: float = 0.4, best: float = 0.2, places: int = 9) -> DataFrame:
    """scored: group, id, taste (0..1 rank share), popularity (0..1), rating, q75 and quality. Little known, well rated,
    among the best fits; by .6 taste + .4 quality."""
    kept = scored.where((F.col("popularity") <= known_most) & (F.col("rating") >= F.col("q75")) & (F.col("taste") >= 1 - best))
    worth = F.round(0.6 * F.col("taste") + 0.4 * F.col("quality"), places)
    return kept.withColumn("worth", worth).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("worth"), "id")))


def tagged_rows(rows: Sequence[tuple[str, Column, Sequence[Column]]], shows: DataFrame, size: int) -> DataFrame:
    """Candidate rows of several kinds in one pass over the shows: row, place, id. rows: name, condition, order."""
    out = None
    for name, holds, order in rows:
        best = shows.where(holds).orderBy(*order, "id").limit(size).withColumn("place", F.row_number().over(Window.orderBy(*order, "id"))).select(F.lit(name).alias("row"), "place", "id")
        out = best if out is None else out.union(best)
    return out


def browse(shows: DataFrame, genre: str, size: int = 20) -> DataFrame:
    """genre, row (top, new, acclaimed, popular), place, id for each genre of the array column: ranks by window, so one
    shuffle for all genres and rows."""
    g = shows.select("id", F.explode(F.array_distinct(genre)).alias("genre"), "popularity", "rating", "year")
    rating, year = F.coalesce("rating", F.lit(-1.0)), F.coalesce("year", F.lit(0))
    orders = {"top": [F.desc(F.round(F.col("popularity") * F.greatest(rating, F.lit(0.0)), 6))], "new": [F.desc(year), F.desc("popularity")], "acclaimed": [F.desc(rating), F.desc("popularity")], "popular": [F.desc("popularity"), F.desc(rating)]}
    out = None
    for name, order in orders.items():
        r = g.select("genre", F.lit(name).alias("row"), F.row_number().over(Window.partitionBy("genre").orderBy(*order, "id")).alias("place"), "id").where(F.col("place") <= size)
        out = r if out is None else out.union(r)
    return out


def regular_share(credits: DataFrame, person: str, show: str, place: str, most: int = 20) -> DataFrame:
    """Share of a person's credits that stand in a cast list of at most `most` people, and how many those are."""
    size = credits.groupBy(show).agg(F.count("*").alias("_n"))
    j = credits.join(size, show)
    regular = F.col("_n") <= most
    return j.groupBy(person).agg(F.count("*").alias("credits"), F.count_if(regular).alias("regular"), (F.count_if(regular) / F.count("*")).alias("share"))


def row_title(adjective: Column, place: Column, core: Column, form: Column, era: Column) -> Column:
    """'Dark Nordic crime series from the 1990s' of the parts that are known."""
    text = F.concat_ws(" ", F.nullif(adjective, F.lit("")), F.nullif(place, F.lit("")), F.nullif(core, F.lit("")), F.coalesce(F.nullif(form, F.lit("")), F.lit("shows")), F.when(era.isNotNull(), F.concat(F.lit("from the "), era)))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000))


def insights(rated: DataFrame, attributes: DataFrame, reference: DataFrame) -> DataFrame:
    """rated: user_id, id, weight; attributes: id, family, value; reference: id. Weighted share of a list's liked shows
    with each value beside the share of the reference, both over the shows that know the family; null without any."""
    liked = rated.where("weight > 0").join(attributes, "id")
    known = liked.select("user_id", "id", "family", "weight").distinct().groupBy("user_id", "family").agg(F.sum("weight").alias("total"))
    mine = liked.groupBy("user_id", "family", "value").agg(F.sum("weight").alias("mass")).join(known, ["user_id", "family"])
    ref = attributes.join(reference.select("id"), "id", "left_semi")
    n = ref.groupBy("family").agg(F.count_distinct("id").alias("known"))
    base = ref.groupBy("family", "value").agg(F.count_distinct("id").alias("c"))
    return mine.join(n, "family", "left").join(base, ["family", "value"], "left").select("user_id", "family", "value", F.try_divide("mass", "total").alias("mine"), F.try_divide(F.coalesce("c", F.lit(0)), F.nullif("known", F.lit(0))).alias("theirs"))


def starter_scores(shows: DataFrame, likeness: DataFrame, language: str, fame: str) -> DataFrame:
    """shows: id, language, fame; likeness: language, id, total (summed over the others). Harmonic mean of a show's fame
    percentile in its language and its mean likeness to all others, scaled by the language's highest."""
    order, ties = Window.partitionBy(language).orderBy(fame), Window.partitionBy(language, fame)
    n = F.count("*").over(Window.partitionBy(language))
    f = (F.rank().over(order) - 1 + (F.count("*").over(ties) + 1) / 2) / n
    j = shows.withColumn("f", f).withColumn("n", n).join(likeness.select(language, "id", "total"), [language, "id"], "left")
    j = j.withColumn("mean", F.coalesce("total", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    r = F.try_divide("mean", F.max("mean").over(Window.partitionBy(language)))
    j = j.withColumn("r", F.coalesce(r, F.lit(0.0)))
    return j.select("id", language, (F.try_divide(2 * F.col("f") * F.col("r"), F.col("f") + F.col("r"))).alias("score"))


def softmax_draw(scored: DataFrame, group: str, key: str, score: str, gumbel: Column, temperature: float = 0.1, window: int = 5) -> DataFrame:
    """One of the best `window` of each group, drawn with weight exp(score / temperature)."""
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("_k") <= window)
    return best.groupBy(group).agg(F.max_by(key, F.struct(F.round(F.col(score) / temperature + gumbel, 9), -F.col("_k"))).alias(key))


def positional_merge(current: DataFrame, incoming: DataFrame, user: str = "user_id") -> DataFrame:
    """current, incoming: user, place, id; current also picked. Picked shows keep their place; the other places take the
    incoming shows in order, without those already there."""
    kept = current.where("picked").select(user, "place", "id")
    fresh = incoming.join(kept.select(user, "id"), [user, "id"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy(user).orderBy("place"))).select(user, "n", "id")
    taken = kept.groupBy(user).agg(F.collect_set("place").alias("taken"))
    size = current.groupBy(user).agg(F.count("*").alias("size")).join(taken, user, "left")
    places = size.select(user, F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))).alias("place"), F.coalesce("taken", F.array().cast("array<int>")).alias("taken")).where(~F.array_contains("taken", F.col("place")))
    free = places.withColumn("n", F.row_number().over(Window.partitionBy(user).orderBy("place"))).join(fresh, [user, "n"]).select(user, "place", "id")
    return kept.union(free)


def poster_colour(pixels: DataFrame, key: str, bins: int = 36, dull: float = 0.25, places: int = 9) -> DataFrame:
    """pixels: key, hue (degrees), weight (saturation times value). The mean hue of the heaviest neighbourhood of hue
    bins, each bin counted with half of the two beside it; null where hardly a pixel has a colour."""
    width = 360 / bins
    b = pixels.where("weight > 0").groupBy(key, (F.floor(F.pmod(F.col("hue"), F.lit(360.0)) / width)).cast("int").alias("bin")).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.sin(F.radians("hue"))).alias("y"), F.sum(F.col("weight") * F.cos(F.radians("hue"))).alias("x"))
    around = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit(1.0).alias("f")), F.struct(F.lit(-1).alias("d"), F.lit(0.5).alias("f")), F.struct(F.lit(1).alias("d"), F.lit(0.5).alias("f"))))
    s = b.select(key, "bin", "w", "x", "y", around.alias("a")).groupBy(key, F.pmod(F.col("bin") + F.col("a.d"), F.lit(bins)).alias("bin")).agg(F.sum(F.col("w") * F.col("a.f")).alias("w"), F.sum(F.col("x") * F.col("a.f")).alias("x"), F.sum(F.col("y") * F.col("a.f")).alias("y"))
    best = s.groupBy(key).agg(F.max_by(F.struct("w", "x", "y"), F.struct(F.round("w", places), -F.col("bin"))).alias("m"))
    total = pixels.groupBy(key).agg(F.avg("weight").alias("mean"))
    hue = F.pmod(F.degrees(F.atan2("m.y", "m.x")), F.lit(360.0))
    return total.join(best, key, "left").select(key, F.when(F.col("mean") >= dull, hue).alias("hue"))


def known_for(roles: DataFrame, person: str, most: int = 3) -> DataFrame:
    """roles: person, kind (regular, created, guest), order, title. The first regular roles; without any what was
    created, else guest roles."""
    rank = F.create_map(F.lit("regular"), F.lit(0), F.lit("created"), F.lit(1), F.lit("guest"), F.lit(2))
    r = roles.withColumn("_r", F.try_element_at(rank, F.col("kind"))).where("_r is not null")
    r = r.withColumn("_least", F.min("_r").over(Window.partitionBy(person))).where("_r = _least")
    return r.withColumn("place", F.row_number().over(Window.partitionBy(person).orderBy("order", "title"))).where(F.col("place") <= most).select(person, "place", "kind", "title")


def birthplace(*parts: Column) -> Column:
    """Place, region and country, without parts that an earlier part already says."""
    return F.array_join(F.aggregate(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), F.array().cast("array<string>"), lambda said, p: F.when(F.exists(said, lambda s: F.contains(F.lower(s), F.lower(p))), said).otherwise(F.array_append(said, p))), ", ")


def ranked_aliases(aliases: DataFrame, key: str, most: int = 12, other_scripts: int = 2) -> DataFrame:
    """aliases: key, name, language, own (the show's language). English names first, then Latin ones, then others, the own
    language leading each; at most `most`, of which `other_scripts` places are kept for other scripts if there are any."""
    from ..functions.text import is_latin

    kind = F.when(~is_latin(F.col("name")), 2).when(F.col("language") == "en", 0).otherwise(1)
    own = F.coalesce(F.col("language") == F.col("own"), F.lit(False))
    d = aliases.groupBy(key, "name").agg(F.min(F.struct(kind.alias("kind"), (~own).cast("int").alias("not_own"), "language")).alias("b")).select(key, "name", "b.*")
    order = Window.partitionBy(key, (F.col("kind") == 2).alias("script")).orderBy("kind", "not_own", "language", "name")
    d = d.withColumn("k", F.row_number().over(order)).withColumn("others", F.least(F.count_if(F.col("kind") == 2).over(Window.partitionBy(key)), F.lit(other_scripts)))
    kept = d.where(F.when(F.col("kind") == 2, F.col("k") <= F.col("others")).otherwise(F.col("k") <= most - F.col("others")))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("kind", "not_own", "language", "name"))).select(key, "place", "name")


#: Columns of a show in its short, full and detailed form.
SHAPES = {
    "card": ("id", "name", "year", "channel", "rating", "language", "type", "known"),
    "tile": ("id", "name", "year", "poster", "genres", "runtime", "type", "summary", "match", "badge", "place"),
    "full": ("id", "name", "year", "runtime", "rating", "genres", "url", "channel", "language", "type", "country", "status", "summary"),
    "detail": ("id", "name", "year", "runtime", "rating", "genres", "url", "channel", "language", "type", "country", "status", "summary", "ended", "premiered", "poster", "art", "themes", "match"),
}


def shaped(shows: DataFrame, shape: str) -> DataFrame:
    """A show in one of the forms above: its columns in order, null for what the table has not."""
    kinds = {"id": "long", "year": "int", "runtime": "int", "rating": "double", "known": "int", "match": "int", "place": "int", "genres": "array<string>", "themes": "array<string>"}
    return shows.select(*(F.col(c) if c in shows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in SHAPES[shape]))


def marked(shows: DataFrame, scores: DataFrame, top: int = 10, newest: Column | None = None, bucket: int = 2500) -> DataFrame:
    """shows: id, popularity, image, theme labels; scores: id, match. Adds poster address, match, badge (top10, new) and
    the place of the `top` best known."""
    address = lambda size: F.when(F.col("image") > 0, F.concat(F.lit(f"https://images.example/{size}/"), F.floor(F.col("image") / bucket).cast("string"), F.lit("/"), F.col("image").cast("string"), F.lit(".jpg")))
    best = shows.orderBy(F.desc("popularity"), "id").limit(top).withColumn("place", F.row_number().over(Window.orderBy(F.desc("popularity"), "id"))).select("id", "place")
    d = shows.join(F.broadcast(best), "id", "left").join(scores.select("id", "match"), "id", "left")
    badge = F.when(F.col("place").isNotNull(), "top10").when(newest if newest is not None else F.lit(False), "new")
    return d.withColumn("poster", address("medium_portrait")).withColumn("art", address("original_untouched")).withColumn("badge", badge)


def sorted_by(shows: DataFrame, sort: str) -> list[Column]:
    """The order of a browsing choice: popularity, rating, newest, shortest or name; unknown values last."""
    orders = {
        "popularity": [F.desc_nulls_last("popularity")], "rating": [F.desc_nulls_last("rating"), F.desc_nulls_last("popularity")], "newest": [F.desc_nulls_last("year"), F.desc_nulls_last("popularity")],
        "shortest": [F.asc_nulls_last("runtime"), F.desc_nulls_last("popularity")], "name": [F.lower("name").asc_nulls_last()],
    }
    return [*orders[sort], F.col("id").asc()]
