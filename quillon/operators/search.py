"""Title search in tiers, from exact to partial, over a table of title words. Searches are a stated set and few: their words
are broadcast, so that titles are not shuffled to meet them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARTICLES, compact_forms, normalize_title, slips
from ..sources.tables import materialise, never_broadcast

#: Words of any script, as the searched phrases have them.
WORDS = r"[\p{L}\p{N}]+"
#: Lines that a word may bring to be weighed as part of a query.
BROAD = 1000


def title_lines(titles: DataFrame) -> DataFrame:
    """titles: id, title, alias (whether it is another title), known, rating, year. One line per distinct normal title
    of a show: its own name first; aliases that are only an article go. Written once, for all tiers, and never broadcast."""
    n = titles.withColumn("line", normalize_title("title")).where("line <> ''")
    n = n.where(~F.col("alias") | ~F.col("line").isin(ARTICLES))
    first = F.row_number().over(Window.partitionBy("id", "line").orderBy("alias", "title"))
    return never_broadcast(materialise(n.withColumn("_k", first).where("_k = 1").drop("_k")))


def prepared(queries: DataFrame) -> DataFrame:
    """queries: query, text. Adds t, the normal text, and words, its distinct words; written once, for all tiers."""
    t = queries.select("query", "text", normalize_title("text").alias("t")).where("t <> ''")
    return materialise(t.withColumn("words", F.array_distinct(F.split("t", " "))))


def best_known(hits: DataFrame, *before: str) -> Window:
    return Window.partitionBy("query").orderBy(*before, F.desc("known"), F.desc(F.coalesce("rating", F.lit(0.0))), F.desc(F.coalesce("year", F.lit(0))), "id")


def line_words(lines: DataFrame) -> DataFrame:
    return lines.select("id", "line", F.explode(F.array_distinct(F.split("line", " "))).alias("word"))


def query_words(q: DataFrame) -> DataFrame:
    """query, n (distinct words), qword, last (whether it is the one still being typed)."""
    return q.select("query", F.size("words").alias("n"), F.explode("words").alias("qword"), F.element_at(F.split("t", " "), -1).alias("w")).select("query", "n", "qword", (F.col("qword") == F.col("w")).alias("last"))


def _forms(df: DataFrame, key: str, normal: str) -> DataFrame:
    return df.select(key, F.explode(compact_forms(F.col(normal))).alias("f")).select(key, "f.*")


def _all_words(matched: DataFrame, lines: DataFrame) -> DataFrame:
    """matched: query, n, qword, word. query, id, line of the lines in which every query word has a matching word."""
    hits = line_words(lines).join(F.broadcast(matched), "word").groupBy("query", "n", "id", "line").agg(F.count_distinct("qword").alias("have"))
    return hits.where("have = n").select("query", "id", "line")


def starting(q: DataFrame, lines: DataFrame) -> DataFrame:
    """query, n, qword, word: title words that a query word starts, met on their first letter."""
    vocabulary = line_words(lines).select("word", F.substring("word", 1, 1).alias("head")).distinct()
    return F.broadcast(query_words(q).withColumn("head", F.substring("qword", 1, 1))).join(vocabulary, "head").where(F.startswith("word", "qword")).select("query", "n", "qword", "word")


def tier_exact(q: DataFrame, lines: DataFrame) -> DataFrame:
    """Tier 1: a compact form of the query is one of the title. q: as prepared; so for all tiers."""
    asked, held = _forms(q, "query", "t").select("query", "form"), _forms(lines, "id", "line").select("id", "form")
    return F.broadcast(asked).join(held, "form").select("query", "id", F.lit(1).alias("tier")).distinct()


def tier_prefix(q: DataFrame, lines: DataFrame) -> DataFrame:
    """Tier 2: a form of the title starts with the query as typed or in digits. Joined on the form's first characters, so
    that it is an equi join. A single character finds nothing here."""
    typed = _forms(q.where(F.length(F.replace("t", F.lit(" "), F.lit(""))) > 1), "query", "t").where("kind in (0, 2)")
    k = F.least(F.length("form"), F.lit(3))
    typed = typed.withColumn("k", k).withColumn("head", F.substring("form", F.lit(1), F.col("k"))).drop("kind")
    held = _forms(lines, "id", "line").select("id", F.col("form").alias("full")).distinct()
    heads = held.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("head", F.substring("full", F.lit(1), F.col("k"))).where(F.length("full") >= F.col("k"))
    return F.broadcast(typed).join(heads, ["k", "head"]).where(F.startswith("full", "form")).select("query", "id", F.lit(2).alias("tier")).distinct()


def tier_words(q: DataFrame, lines: DataFrame) -> DataFrame:
    """Tier 3: every query word starts a word of one title."""
    return _all_words(starting(q, lines), lines).select("query", "id", F.lit(3).alias("tier")).distinct()


def tier_inside(q: DataFrame, lines: DataFrame) -> DataFrame:
    """Tier 4: every query word starts a word of one title or, of three letters or more, sits inside one; there must be
    such a long word. Words inside are found by the three letters they begin with, at any place of a title word."""
    long = query_words(q).where(F.length("qword") > 2)
    places = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 2, F.lit(1))), lambda k: F.substring(F.col("word"), k, F.lit(3))))
    vocabulary = line_words(lines).select("word").distinct().select("word", places.alias("head")).distinct()
    inside = F.broadcast(long.withColumn("head", F.substring("qword", 1, 3))).join(vocabulary, "head").where(F.contains("word", "qword")).select("query", "n", "qword", "word")
    either = starting(q, lines).join(long.select("query").distinct(), "query", "left_semi").union(inside).distinct()
    return _all_words(either, lines).select("query", "id", F.lit(4).alias("tier")).distinct()


def deletions(word):
    """A word and every string with one character less: words one slip apart share one of these."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    return F.array_distinct(F.array_append(cut, word))


def near_words(words: DataFrame, lines: DataFrame) -> DataFrame:
    """words: query, n, qword. With word: title words one slip from a query word of 3 to 20 letters. Candidates share a
    string with one letter less, or are alike with double letters single; the slip itself is checked after."""
    q = words.where(F.length("qword").between(3, 20)).select("query", "n", "qword")
    once = lambda c: F.regexp_replace(c, r"(.)\1+", "$1")
    keys = lambda c: F.explode(F.concat(deletions(F.col(c)), F.array(F.concat(F.lit("2"), once(F.col(c))))))
    vocabulary = line_words(lines).select("word").distinct().where(F.length("word") <= 22).select("word", keys("word").alias("key")).distinct()
    return q.select("*", keys("qword").alias("key")).distinct().join(vocabulary, "key").select("query", "n", "qword", "word").distinct().where(slips(F.col("qword"), F.col("word")))


def typing_words(words: DataFrame, lines: DataFrame) -> DataFrame:
    """words: query, n, qword, last. Title words that start with a string one slip from the last word, of 4 to 20 letters,
    and with its first letter: the word is still being typed. Joined on the first letter."""
    q = words.where(F.col("last") & F.length("qword").between(4, 20)).select("query", "n", "qword", F.substring("qword", 1, 1).alias("head"))
    vocabulary = line_words(lines).select("word", F.substring("word", 1, 1).alias("head")).distinct()
    n = F.length("qword")
    start = F.exists(F.sequence(F.greatest(n - 2, F.lit(4)), n + 2), lambda k: (k <= F.length("word")) & slips(F.col("qword"), F.substring(F.col("word"), F.lit(1), k)))
    return q.join(vocabulary, "head").where(start).select("query", "n", "qword", "word")


def tier_typos(q: DataFrame, lines: DataFrame) -> DataFrame:
    """Tier 5: each query word starts a title word or is one slip from a whole one, or for the last word one slip from the
    start of one; at least one slipped. With the number that did."""
    words = query_words(q)
    slipped = near_words(words, lines).union(typing_words(words, lines)).distinct().withColumn("slips", F.lit(1))
    matched = starting(q, lines).withColumn("slips", F.lit(0)).union(slipped)
    best = matched.join(line_words(lines), "word").groupBy("query", "n", "id", "line", "qword").agg(F.min("slips").alias("slips"))
    hits = best.groupBy("query", "n", "id", "line").agg(F.count("*").alias("have"), F.sum("slips").alias("slips")).where("have = n and slips > 0")
    return hits.groupBy("query", "id").agg(F.min("slips").cast("int").alias("slips")).select("query", "id", F.lit(5).alias("tier"), "slips")


def tier_initials(q: DataFrame, lines: DataFrame, broad: int = BROAD) -> DataFrame:
    """Tier 6: a query word of 3 to 6 Latin letters or digits stands for as many consecutive words of a title by their first
    letters, and every other query word starts a word of it. A word that starts words of more than `broad` titles is taken
    as itself. Lines are met by the runs of 3 to 6 initials they have; starts says whether the word starts any word."""
    starts = line_words(lines).join(F.broadcast(starting(q, lines)), "word").groupBy("query", "qword").agg(F.count_distinct("id", "line").alias("lines"))
    short = query_words(q).where(F.col("qword").rlike("^[a-z0-9]{3,6}$")).select("query", "qword").join(starts, ["query", "qword"], "left").where(F.coalesce("lines", F.lit(0)) <= broad)
    initials = lines.select("id", "line", F.array_join(F.transform(F.split("line", " "), lambda w: F.substring(w, 1, 1)), "").alias("i")).where(F.length("i") > 2)
    n = F.length("i")
    runs = F.flatten(F.transform(F.sequence(F.lit(3), F.least(n, F.lit(6))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substring(F.col("i"), at, k))))
    met = short.join(initials.select("id", "line", F.explode(F.array_distinct(runs)).alias("qword")), "qword").join(q.select("query", "words"), "query")
    others = F.forall(F.array_except("words", F.array("qword")), lambda w: F.exists(F.split("line", " "), lambda x: F.startswith(x, w)))
    return met.where(others).groupBy("query", "id").agg(F.max(F.col("lines").isNotNull()).alias("starts")).select("query", "id", F.lit(6).alias("tier"), "starts")


def tier_part(q: DataFrame, lines: DataFrame, title_least: float = 0.5, query_least: float = 0.25, broad: int = BROAD, places: int = 3) -> DataFrame:
    """Tier 7: query of several words and title share words; how much of each the other covers, a word weighing
    ln((lines + 1) / (lines with it + 1)), as a harmonic mean. A query word of more than four letters that no title has
    counts for the title words one slip from it. A title is looked at for the sake of a word that few lines have."""
    several = q.where(F.size("words") > 1)
    w = line_words(lines)
    n = lines.agg(F.count("*").alias("lines"))
    weight = F.log((F.col("lines") + 1).cast("double") / (F.coalesce("df", F.lit(0)) + 1))
    df = w.groupBy("word").agg(F.count("*").alias("df"))
    asked = query_words(several).join(df.withColumnRenamed("word", "qword"), "qword", "left").join(F.broadcast(n)).select("query", "n", "qword", weight.alias("asked"), "df")
    unknown = asked.where(F.col("df").isNull() & (F.length("qword") > 4)).select("query", "n", "qword")
    matches = asked.where("df is not null").select("query", "qword", F.col("qword").alias("word")).union(near_words(unknown, lines).select("query", "qword", "word"))
    matches = materialise(matches.join(df, "word").withColumn("brings", F.sum("df").over(Window.partitionBy("query", "qword"))))
    pool = matches.where(F.col("brings") <= broad).select("query", "word").distinct().join(w, "word").select("query", "id", "line").distinct()
    parts = pool.withColumn("word", F.explode(F.split("line", " "))).join(df, "word").join(F.broadcast(n)).withColumn("weight", weight).join(matches.select("query", "word", "qword"), ["query", "word"], "left")
    covered = parts.groupBy("query", "id", "line").agg(F.collect_set("qword").alias("have"))
    sized = parts.dropDuplicates(["query", "id", "line", "word"]).withColumn("times", F.size(F.filter(F.split("line", " "), lambda x: x == F.col("word"))))
    sized = sized.groupBy("query", "id", "line").agg(F.sum(F.col("weight") * F.col("times")).alias("whole"), F.sum(F.when(F.col("qword").isNotNull(), F.col("weight") * F.col("times")).otherwise(0.0)).alias("both"))
    total = asked.groupBy("query").agg(F.sum("asked").alias("total"))
    mine = covered.select("query", "id", "line", F.explode("have").alias("qword")).join(asked.select("query", "qword", "asked"), ["query", "qword"]).groupBy("query", "id", "line").agg(F.sum("asked").alias("mine"))
    a, b = F.try_divide("both", "whole"), F.try_divide("mine", "total")
    kept = sized.join(mine, ["query", "id", "line"]).join(total, "query").where((F.round(a, 9) >= title_least) & (F.round(b, 9) >= query_least)).withColumn("cover", F.round(F.round(2 * a * b / (a + b), 9), places))
    return kept.groupBy("query", "id").agg(F.max("cover").alias("cover")).select("query", "id", F.lit(7).alias("tier"), "cover")


def find(queries: DataFrame, titles: DataFrame, limit: int = 12) -> DataFrame:
    """All tiers. Guesses (5 and 7, and initials of a word that starts some title word) are for queries that match nothing
    as typed: none for those that tiers 1 to 3 answer."""
    q, lines = prepared(queries), title_lines(titles)
    strong = materialise(tier_exact(q, lines).union(tier_prefix(q, lines)).union(tier_words(q, lines)))
    settled = strong.select("query").distinct()
    open_ = q.join(settled, "query", "left_anti")
    initials = tier_initials(q, lines).join(settled.withColumn("settled", F.lit(True)), "query", "left").where("settled is null or not starts")
    return first_tiers([strong, tier_inside(q, lines), tier_typos(open_, lines), initials, tier_part(open_, lines)], titles, limit)


def first_tiers(tiers: list[DataFrame], titles: DataFrame, limit: int = 12) -> DataFrame:
    """The lowest tier that finds a show, best known first within a tier."""
    union = None
    for t in tiers:
        t = t.select("query", "id", "tier")
        union = t if union is None else union.union(t)
    found = union.groupBy("query", "id").agg(F.min("tier").alias("tier")).join(never_broadcast(titles.select("id", "known", "rating", "year").distinct()), "id")
    return found.withColumn("place", F.row_number().over(best_known(found, "tier"))).where(F.col("place") <= limit).select("query", "place", "id", "tier")


def year_first(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """hits: query, text, id, place. A year at the end of a query puts the shows that premiered then first."""
    year = F.try_to_number(F.regexp_extract("text", r"\b((?:19|20)\d\d)\s*$", 1), F.lit("9999")).cast("int")
    named = hits.join(titles.select("id", "year").distinct(), "id").withColumn("_other", (~F.coalesce(F.col("year") == year, F.lit(False))).cast("int"))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("_other", "place"))).drop("_other")


def contains_all(queries: DataFrame, shows: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The study's search: every token is in the lower-cased name; names that start with the query first, then the
    better known, then the shorter name."""
    q = F.broadcast(queries.select("query", F.lower("text").alias("q")))
    low = F.lower(F.col(name))
    every = F.forall(F.split("q", r"\s+"), lambda t: F.contains(low, t))
    hits = shows.join(q, every)
    order = Window.partitionBy("query").orderBy((~F.startswith(low, F.col("q"))).cast("int"), F.desc("known"), F.length(name), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query", "place", "id")


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, phrase of texts that hold a phrase as whole words, each once; phrases that more than `most` texts hold say
    nothing. Texts and phrases meet on the first two words of a phrase (or its only one), so neither is sent to all."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0))
    t = texts.select(key, words.alias("w"))
    after = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
    pairs = F.filter(F.zip_with("w", after, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    p = phrases.select("phrase", F.array_join(F.slice(F.split("phrase", " "), 1, 2), " ").alias("head")).distinct()
    heads = t.select(key, F.explode(F.array_distinct(F.concat("w", pairs))).alias("head"))
    near = heads.join(p, "head").select(key, "phrase")
    padded = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    hits = near.join(t.select(key, padded.alias("p")), key).where(F.contains("p", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select(key, "phrase").distinct()
    if most is None:
        return hits
    return hits.withColumn("_n", F.count("*").over(Window.partitionBy("phrase"))).where(F.col("_n") <= most).drop("_n")


def just_added(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Tier of titles that are not in the catalogue yet: 1 the same compact form, 2 it starts with the query's, 3 every
    query word starts a word; the best of each title, current ones first. titles: id, title, current."""
    lines = never_broadcast(materialise(titles.select("id", normalize_title("title").alias("line"), "current").where("line <> ''")))
    q = prepared(queries)
    found = tier_exact(q, lines).union(tier_prefix(q, lines)).union(tier_words(q, lines))
    best = found.groupBy("query", "id").agg(F.min("tier").alias("tier")).join(lines.select("id", "current"), "id")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("tier", F.desc("current"), "id"))).select("query", "place", "id", "tier")


def topics(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: label, source (lower is better), topic. The topic that a query's words name, in singular or plural, by the
    best source."""
    from ..functions.text import number_variants

    q = queries.select("query", F.explode(number_variants(normalize_title("text"))).alias("name"))
    named = q.join(labels.select(F.lower("label").alias("name"), "source", "topic"), "name")
    return named.groupBy("query").agg(F.min_by("topic", F.struct("source", "topic")).alias("topic"))


def recent_matches(recent: DataFrame, text: str, typed) -> DataFrame:
    """Recent searches that start with what is typed, or have a word that does."""
    low = F.lower(F.trim(typed))
    return recent.where(F.startswith(F.lower(text), low) | F.contains(F.concat(F.lit(" "), F.lower(text)), F.concat(F.lit(" "), low)))
