"""License scan by diagonal voting, in DataFrame functions only.

Every document's rolling word k-gram hashes are joined to the places of the same hashes in license templates. A hit
votes for the diagonal document place - template place. Votes are summed by diagonal, diagonals that are neighbours
(a word more or less) are merged, and a merged run counts if it covers enough places of its template, each once, within
a span of about the template's length. Base phrases are templates whose diagonal must be complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening words of public license notices, and short statements, by label.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0-text", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-notice", "licensed under the apache license version"),
    ("gpl-notice", "licensed under the gnu general public license version"),
    ("mit-notice", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "licensed under a creative commons attribution"),
)

#: Words of a gram: two for base phrases, three for templates.
SHORT, LONG = 2, 3
#: Merged diagonals lie at most so many words apart; a run must cover this share of its template's grams within a span
#: of at most this many times the template's words.
NEIGHBOUR, COVERAGE, STRETCH = 2, 0.7, 1.5

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the document itself among its grams, so that documents without a hit keep a row.
_SELF = -1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each place on; the last k - 1 places have shorter grams, which no template holds."""
    out = F.transform(words, lambda w: F.xxhash64(F.lit(k), w))
    for j in range(1, k):
        out = F.zip_with(out, F.slice(words, F.lit(j + 1), F.greatest(F.size(words), F.lit(1))), lambda h, w: F.xxhash64(h, F.coalesce(w, F.lit(" "))))
    return out


def template_positions(spark: SparkSession) -> DataFrame:
    """gram_hash, template, place, grams: a row for each gram of the templates; fixed size."""
    rows = [(n, label, text.split(), SHORT) for n, (text, label) in enumerate(BASE)]
    rows += [(len(BASE) + n, label, text.split(), LONG) for n, (label, text) in enumerate(TEMPLATES)]
    own = spark.createDataFrame([(_SELF, -1, 0, 0)], "gram_hash long, template int, place int, grams int")
    for k in (SHORT, LONG):
        t = spark.createDataFrame([(n, w, len(w) - k + 1) for n, _, w, kk in rows if kk == k], "template int, words array<string>, grams int")
        own = own.union(t.select(F.posexplode(gram_hashes(F.col("words"), k)).alias("place", "gram_hash"), "template", "grams").where("place < grams").select("gram_hash", "template", "place", "grams"))
    return own


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word,
    words, coverage of each verified run).

    A null text is empty: no words, no labels, score 0. Very long texts are scanned whole; null and repeated keys stay rows
    of their own; no rows, no result; other columns are left out. The score is the best coverage of a verified run, 1 for a base phrase."""
    spark = docs.sparkSession
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    grams = words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(gram_hashes(F.col("words"), SHORT), gram_hashes(F.col("words"), LONG), F.array(F.lit(_SELF).cast("long")))).alias("at", "gram_hash"))
    # the template table has a fixed few hundred rows: broadcast, so that the grams are never shuffled
    hits = grams.join(F.broadcast(template_positions(spark)), "gram_hash")
    place = F.when(F.col("at") < F.col("n_words"), F.col("at")).otherwise(F.col("at") - F.col("n_words"))
    votes = (
        hits.select("row", "doc_id", "n_words", "template", "grams", (place - F.col("place")).cast("long").alias("diagonal"), place.cast("long").alias("word"), F.expr("shiftleft(1L, place)").alias("bit"))
        .withColumn("diagonal", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("diagonal")))
        .groupBy("row", "doc_id", "n_words", "template", "grams", "diagonal")
        .agg(F.bit_or("bit").alias("places"), F.min("word").alias("low"), F.max("word").alias("high"))  # templates have less than 63 grams
    )
    # base phrases are never merged: their run is their diagonal
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True)) | (F.col("template") < len(BASE))
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(order)).groupBy("row", "doc_id", "n_words", "template", "grams", "run").agg(F.bit_count(F.bit_or("places")).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"))
    label = F.element_at(F.array(*(F.lit(x) for x in [*(b[1] for b in BASE), *(t[0] for t in TEMPLATES)])), F.col("template") + 1)
    is_base = (F.col("template") >= 0) & (F.col("template") < len(BASE)) & (F.col("covered") == F.col("grams"))
    coverage = F.col("covered") / F.col("grams")
    verified = (F.col("template") >= len(BASE)) & (coverage >= COVERAGE) & (F.col("high") - F.col("low") + 1 <= STRETCH * F.col("grams"))
    out = runs.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("diagonal"))).alias("first_word"), F.max(F.when(is_base, F.col("diagonal"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, label))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(F.when(is_base | verified, label))), ",").alias("labels"),
        F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(verified, coverage)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(is_base | verified, F.struct(label.alias("label"), F.col("low").alias("first_word"), (F.col("high") - F.col("low") + F.when(is_base, SHORT).otherwise(LONG)).alias("words"), coverage.alias("coverage"))))).alias("spans"),
    )
    return out.drop("row")


def license_scan(docs: DataFrame) -> DataFrame:
    """scan() without the spans."""
    return scan(docs).drop("spans")


def oracle() -> str:
    """DuckDB SQL for license_scan over the view documents, with the grams' words instead of hashes."""
    rows = [(n, label, text, SHORT) for n, (text, label) in enumerate(BASE)] + [(len(BASE) + n, label, text, LONG) for n, (label, text) in enumerate(TEMPLATES)]
    values = ", ".join(f"({n}, '{label}', '{text}', {k})" for n, label, text, k in rows)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) v(template, label, text, k)),
tw AS (SELECT template, label, k, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM t),
tg AS (SELECT template, label, k, p AS place, max(p) OVER (PARTITION BY template) + 2 - k AS grams, w AS w1, lead(w, 1) OVER o AS w2, CASE WHEN k = {LONG} THEN lead(w, 2) OVER o END AS w3
       FROM tw WINDOW o AS (PARTITION BY template ORDER BY p)),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p FROM d),
dg AS (SELECT r, p, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM dw WINDOW o AS (PARTITION BY r ORDER BY p)),
votes AS (SELECT r, template, any_value(label) AS label, any_value(grams) AS grams, p - place AS diagonal, list(place) AS places, min(p) AS low, max(p) AS high
          FROM dg JOIN tg ON dg.w1 = tg.w1 AND dg.w2 = tg.w2 AND (k = {SHORT} OR dg.w3 = tg.w3) WHERE place < grams GROUP BY r, template, p - place),
marked AS (SELECT *, CASE WHEN template < {len(BASE)} OR coalesce(diagonal - lag(diagonal) OVER o > {NEIGHBOUR}, TRUE) THEN 1 ELSE 0 END AS apart FROM votes WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM marked),
runs AS (SELECT r, template, any_value(label) AS label, any_value(grams) AS grams, len(list_distinct(flatten(list(places)))) AS votes, min(low) AS low, max(high) AS high, min(diagonal) AS diagonal FROM numbered GROUP BY r, template, run),
judged AS (SELECT *, template < {len(BASE)} AND votes = grams AS is_base, votes / grams AS coverage,
                  template >= {len(BASE)} AND votes / grams >= {COVERAGE} AND high - low + 1 <= {STRETCH} * grams AS verified FROM runs),
summed AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(diagonal) FILTER (is_base) AS first_word, max(diagonal) FILTER (is_base) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base OR verified) AS labels,
                  max(CASE WHEN is_base THEN 1.0 WHEN verified THEN coverage END)::DOUBLE AS score FROM judged GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN summed USING (r)
"""
