"""TF-IDF, facets and closeness: long tables (row, col, value) joined on their columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import cosine
from ..functions.buckets import quantised
from ..sources.tables import materialise, never_broadcast, numbered
from . import blocks

# ------------------------------------------------------------------ text


def terms(df: DataFrame, key: str, text: str, stop: Sequence[str] = (), ngrams: int = 2, pattern: str = r"[\p{L}\p{N}_]{2,}") -> DataFrame:
    """key, term, tf: words of the lower-cased text without stop words, and pairs of words that are then neighbours. Texts are
    dealt by key before they are cut, so the counts need no shuffle of their own."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    d = df.select(key, text).repartition(F.col(key)).select(key, words.alias("w"))
    grams = F.col("w")
    if ngrams > 1:
        after = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
        pairs = F.filter(F.zip_with("w", after, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))), lambda x: x.isNotNull())
        grams = F.concat("w", pairs)
    return d.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_idf(tf: DataFrame, key: str, rows: DataFrame, min_df: int = 3, max_df: float = 0.7, max_features: int | None = 40_000) -> DataFrame:
    """key, term, value: 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, scaled to unit length by row. `rows` are all rows
    that count as documents. The terms kept are those of the highest corpus count, ties to the smaller term; up to so many of
    them are broadcast."""
    n = rows.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_features:
        df = df.orderBy(F.desc("total"), "term").limit(max_features)
    idf = df.select("term", (F.log((1 + F.col("n")).cast("double") / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(F.broadcast(idf) if max_features else idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("v") / norm).alias("value"))


def keywords(vectors: DataFrame, key: str, most: int = 6) -> DataFrame:
    """The heaviest terms of each row, skipping any that holds or is held by one chosen before; at most `most`.

    A fold over all terms of a row, heaviest first, ties to the smaller term; once `most` are found the rest pass by."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.round("value", 9)).alias("w"), "term")))
    empty = F.array().cast("array<string>")
    step = lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: F.contains(y, x["term"]) | F.contains(x["term"], y)), acc).otherwise(F.array_append(acc, x["term"]))
    return vectors.groupBy(key).agg(ordered.alias("t")).select(key, F.aggregate("t", empty, step).alias("keywords"))


def plot_words(words: Column, summary: Column, most: int = 4) -> Column:
    """Keywords of two words, and those that stand in the summary in lower case as a word."""
    quoted = lambda w: F.concat(F.lit(r"(^|[^A-Za-z0-9_])\Q"), w, F.lit(r"\E($|[^A-Za-z0-9_])"))
    return F.slice(F.filter(words, lambda w: F.contains(w, F.lit(" ")) | F.regexp(F.coalesce(summary, F.lit("")), quoted(w))), 1, most)


# ------------------------------------------------------------------ facets


def facet_values(tokens: DataFrame, key: str, shows: int | DataFrame, min_df: int = 2) -> DataFrame:
    """tokens: key, family, token, multiplier. ln(N / df) times the multiplier, unit length within (key, family). Tokens
    of fewer than min_df rows, or of all, go; of repeated tokens the highest multiplier counts. N: `shows`. Several rows a show, so never broadcast."""
    best = tokens.groupBy(key, "family", "token").agg(F.max("multiplier").alias("m"))
    df = best.groupBy("family", "token").agg(F.count("*").alias("df"))
    n = F.lit(shows) if isinstance(shows, int) else F.col("_n")
    if not isinstance(shows, int):
        df = df.join(F.broadcast(shows.agg(F.count("*").alias("_n"))))
    idf = df.where(F.col("df") >= min_df).withColumn("idf", F.log(n / F.col("df"))).where("idf > 0").select("family", "token", "df", "idf")
    v = never_broadcast(best).join(idf, ["family", "token"]).withColumn("v", F.col("m") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key, "family")))
    return never_broadcast(v.select(key, "family", "token", "df", (F.col("v") / norm).alias("value")))


def coverage(values: DataFrame, key: str) -> DataFrame:
    return values.groupBy("family").agg(F.count_distinct(key).alias("shows"), F.count_distinct("token").alias("tokens"), F.count("*").alias("links"))


def family_cosines(values: DataFrame, key: str, left: DataFrame | None = None) -> DataFrame:
    """a, b, family, cosine of rows that share a token. left: restrict a to these keys (column `key`)."""
    mine = values if left is None else values.join(left.select(key), key, "left_semi")
    a = mine.select(F.col(key).alias("a"), "family", "token", F.col("value").alias("x"))
    b = values.select(F.col(key).alias("b"), "family", "token", F.col("value").alias("y"))
    return a.join(b, ["family", "token"]).where("a <> b").groupBy("a", "b", "family").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def facet_closeness(cosines: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """a, b, f: weighted sum of family cosines over the sum of all weights."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    w = F.coalesce(F.try_element_at(table, F.col("family")), F.lit(0.0))
    return cosines.where(w > 0).groupBy("a", "b").agg((F.sum(w * F.col("cosine")) / float(sum(weights.values()))).alias("f"))


def presence_weights(values: DataFrame, key: str) -> DataFrame:
    """Each value over the largest of its row and family: the multiplier it came from, for equal idf."""
    return values.withColumn("presence", F.col("value") / F.max("value").over(Window.partitionBy(key, "family")))


def holders(values: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """Keys that carry any of the tokens (family, token)."""
    return values.join(tokens.select("family", "token").distinct(), ["family", "token"], "left_semi").select(key).distinct()


def sharing(pairs: DataFrame, values: DataFrame, key: str, family: str) -> DataFrame:
    """Those of the pairs (a, b) that share a token of the family."""
    v = values.where(F.col("family") == family)
    return pairs.select("a", "b").join(v.select(F.col(key).alias("a"), "token"), "a").join(v.select(F.col(key).alias("b"), "token"), ["b", "token"], "left_semi").select("a", "b").distinct()


def ties(values: DataFrame, key: str, pairs: DataFrame, order: Sequence[str], rows: int, common: float = 0.01, most: int = 4, single: str = "genre") -> DataFrame:
    """What each pair (a, b) concretely shares: rare tokens by family order and strength, one of the `single` family."""
    rare = values.where(F.col("df") <= common * rows)
    rank = F.create_map(*(x for k, f in enumerate(order) for x in (F.lit(f), F.lit(k))))
    a = rare.select(F.col(key).alias("a"), "family", "token", F.col("value").alias("x"))
    b = rare.select(F.col(key).alias("b"), "family", "token", F.col("value").alias("y"))
    shared = pairs.select("a", "b").join(a, "a").join(b, ["b", "family", "token"]).withColumn("o", F.try_element_at(rank, F.col("family"))).where("o is not null")
    by_strength = Window.partitionBy("a", "b", "family").orderBy(F.desc(F.round(F.col("x") * F.col("y"), 9)), "token")
    shared = shared.withColumn("k", F.row_number().over(by_strength)).where((F.col("family") != single) | (F.col("k") == 1))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("o", F.desc(F.round(F.col("x") * F.col("y"), 9)), "token"))
    return shared.withColumn("place", place).where(F.col("place") <= most).select("a", "b", "place", "family", "token")


def parent_hops(facts: DataFrame, parents: DataFrame, vocabulary: DataFrame, levels: int = 2, decay: float = 0.5) -> DataFrame:
    """facts: item, value, multiplier; parents: value, parent. Values of the vocabulary that an item carries itself or by
    up to `levels` superclasses, each hop at `decay` of the weight; the highest weight of each."""
    every, level = facts.select("item", "value", "multiplier"), facts.select("item", "value", "multiplier")
    for _ in range(levels):
        level = level.join(parents, "value").select("item", F.col("parent").alias("value"), (F.col("multiplier") * decay).alias("multiplier"))
        level = level.groupBy("item", "value").agg(F.max("multiplier").alias("multiplier"))
        every = every.union(level)
    return every.join(vocabulary.select("value"), "value", "left_semi").groupBy("item", "value").agg(F.max("multiplier").alias("multiplier"))


def inherited(members: DataFrame, facts: DataFrame, share: float = 1 / 3) -> DataFrame:
    """members: whole, part; facts: part, value. Values that at least `share` of a whole's parts carry, with the share."""
    n = members.groupBy("whole").agg(F.count_distinct("part").alias("parts"))
    held = members.join(facts, "part").groupBy("whole", "value").agg(F.count_distinct("part").alias("have"))
    return held.join(n, "whole").withColumn("share", F.col("have") / F.col("parts")).where(F.col("share") >= share).select("whole", "value", "share")


# ------------------------------------------------------------------ closeness


def text_cosines(vectors: DataFrame, key: str, left: DataFrame | None = None) -> DataFrame:
    """a, b, t over the inverted index: rows that share a term."""
    mine = vectors if left is None else vectors.join(left.select(key), key, "left_semi")
    a = mine.select(F.col(key).alias("a"), "term", F.col("value").alias("x"))
    b = vectors.select(F.col(key).alias("b"), "term", F.col("value").alias("y"))
    return a.join(b, "term").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("t"))


def nearest_texts(vectors: DataFrame, key: str, asked: DataFrame, k: int = 10) -> DataFrame:
    """a, b, score, rank: for the asked rows (column `key`) the k rows of largest text cosine. Vectors are
    compared in blocks, so a term that most rows have joins nothing."""
    rows = materialise(blocks.sparse(vectors, key, ["term"], "value"))
    return blocks.nearest(rows.join(asked.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi"), rows, k)


def blend(t: Column, h: Column, g: Column, f: Column, text: float = 40, themes: float = 35, genres: float = 25, facets: float = 30) -> Column:
    """Story, themes and genres share their weights out; facets come on top. Missing parts are 0."""
    total = text + themes + genres
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return z(t) * (text / total) + z(h) * (themes / total) + z(g) * (genres / total) + z(f) * (facets / 100)


def closeness(shows: DataFrame, texts: DataFrame, facets: DataFrame, left: DataFrame, **weights: float) -> DataFrame:
    """a, b, near for every a of `left` (id) with every show: a stated query set against all rows, for scores that need
    them all. shows: id, theme_bits, genre_bits; texts: a, b, t; facets: a, b, f."""
    mine = shows.join(left.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("theme_bits").alias("ta"), F.col("genre_bits").alias("ga"))
    pairs = shows.select(F.col("id").alias("b"), "theme_bits", "genre_bits").join(mine, F.col("a") != F.col("b"))
    joined = pairs.join(texts, ["a", "b"], "left").join(facets, ["a", "b"], "left")
    return joined.select("a", "b", blend(F.col("t"), cosine(F.col("ta"), F.col("theme_bits")), cosine(F.col("ga"), F.col("genre_bits")), F.col("f"), **weights).alias("near"))


def closeness_cells(shows: DataFrame, texts: DataFrame, facets: DataFrame, weights: Mapping[str, float], text: float = 40, themes: float = 35, genres: float = 25, facet: float = 30) -> DataFrame:
    """id, kind, token, value, such that the inner product of two shows' cells is their closeness (blend): every part is a
    cosine, so each show's unit vector of a part is scaled by the root of what the part weighs. shows: id, theme_bits,
    genre_bits; texts: id, token, value; facets: id, family, token, value, both of unit length (a facet within its
    family); weights: of the facet families."""
    total = text + themes + genres

    def flags(kind: str, column: str, share: float) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit(F.col(column), k) == 1)
        return F.transform(held, lambda k: F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("token"), (share**0.5 / F.sqrt(F.bit_count(column).cast("double"))).alias("value")))

    set_ = shows.select("id", F.explode(F.concat(flags("themes", "theme_bits", themes / total), flags("genres", "genre_bits", genres / total))).alias("c")).select("id", "c.*")
    words = texts.select("id", F.lit("text").alias("kind"), F.col("token"), (F.col("value") * (text / total) ** 0.5).alias("value"))
    table = F.create_map(*(F.lit(x) for f, w in weights.items() for x in (f, (facet / 100 * w / sum(weights.values())) ** 0.5)))
    rest = facets.select("id", F.concat(F.lit("facet "), F.col("family")).alias("kind"), "token", (F.col("value") * F.try_element_at(table, F.col("family"))).alias("value")).where("value > 0")
    return set_.union(words).union(rest)


def facet_cells(facets: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """id, kind, token, value, such that the inner product of two shows' cells is their facet closeness (`facet_closeness`).
    facets: id, family, token, value, of unit length within a family; weights: of the facet families."""
    table = F.create_map(*(F.lit(x) for f, w in weights.items() for x in (f, (w / sum(weights.values())) ** 0.5)))
    return facets.select("id", F.col("family").alias("kind"), "token", (F.col("value") * F.try_element_at(table, F.col("family"))).alias("value")).where("value > 0")


def cell_vectors(cells: DataFrame) -> DataFrame:
    """The cells as id, cols, vals for blocks.nearest; written."""
    return materialise(blocks.sparse(cells, "id", ["kind", "token"], "value"))


def pair_closeness(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The closeness of given pairs (a, b): a, b, near; pairs that share no cell have 0."""
    x = cells.select(F.col("id").alias("a"), "kind", "token", F.col("value").alias("x"))
    y = cells.select(F.col("id").alias("b"), "kind", "token", F.col("value").alias("y"))
    found = pairs.select("a", "b").join(x, "a").join(y, ["b", "kind", "token"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("near"))
    return pairs.select("a", "b").join(found, ["a", "b"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))


def paired_parts(cosines: DataFrame, text: str, weights: Mapping[str, float]) -> DataFrame:
    """a, b, t (cosine of the text family), f (facet closeness) of family cosines, in one grouping."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    w = F.coalesce(F.try_element_at(table, F.col("family")), F.lit(0.0))
    return cosines.groupBy("a", "b").agg(F.sum(F.when(F.col("family") == text, F.col("cosine"))).alias("t"), (F.sum(w * F.col("cosine")) / float(sum(weights.values()))).alias("f"))


def top_neighbours(edges: DataFrame, a: str, b: str, score: str, k: int = 48, places: int = 9) -> DataFrame:
    """The k closest of each a, ties to the smaller b; rank from 1. Zero scores are no neighbours."""
    order = Window.partitionBy(a).orderBy(F.desc(F.round(score, places)), b)
    return edges.where(F.col(score) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def degrees(edges: DataFrame, b: str, most: int = 65_535) -> DataFrame:
    """How many lists each node is in, capped as the stored form is."""
    return edges.groupBy(F.col(b).alias("node")).agg(F.least(F.count("*"), F.lit(most)).alias("degree"))


def evidence(edges: DataFrame, degree: DataFrame, width: int, hub: float = 0.3, broad: float = 0.5, text: float = 0.40, rest: float = 0.60, facets: float = 0.30) -> DataFrame:
    """edges: i, j, t (plot text), y (weighted themes and genres), f (facet part). What i adds to j in a long list:
    themes and genres at `broad`, less for hubs, which are in many lists: (degree / width) ^ -hub, at most 1."""
    z = text + broad * rest
    damp = F.least(F.pow(F.col("degree") / width, F.lit(-hub)), F.lit(1.0))
    return edges.join(degree, edges["j"] == degree["node"]).select("i", "j", (((text * F.col("t") + broad * F.col("y")) / z + facets * F.col("f")) * damp).alias("evidence"))


def packed_neighbours(edges: DataFrame, near_most: float = 4.5, bonus_most: float = 11.2) -> DataFrame:
    """The stored form: closeness, text and bonus as bytes."""
    return edges.withColumn("near", quantised(F.col("near"), near_most)).withColumn("text", quantised(F.col("text"), 1.0)).withColumn("bonus", quantised(F.col("bonus"), bonus_most))


def dense_neighbours(df: DataFrame, key: str, vector: str, queries: Column | None = None, k: int = 5, places: int = 6) -> DataFrame:
    """a, b, cosine, rank: cosine neighbours of dense vectors, by blocks; `queries` picks the rows that ask."""
    d = df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    d = d.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("n > 0")
    d = d.select("id", F.sequence(F.lit(0), F.size("v") - 1).alias("cols"), F.transform("v", lambda x: x / F.col("n")).alias("vals"))
    asked = d if queries is None else d.join(df.where(queries).select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    return blocks.nearest(asked, d, k, -2.0, places).select("a", "b", F.round("score", places).alias("cosine"), "rank")
