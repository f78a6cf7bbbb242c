"""Helpers against hand-made cases."""

import json

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import ranking, rows, sets
from quillon.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles(spark):
    assert text.normal_title("L'Étoile & the Cat's  Eye") == "l etoile and the cats eye" and text.normal_title("Qu'il d’Artagnan 'l' o'clock") == "qu il d artagnan l oclock"
    digits = lambda t: one(spark, text.in_digits(F.split(F.lit(t), " ")))
    assert digits("brooklyn nine nine") == ["brooklyn", "9", "9"] and digits("twenty one pilots") == ["21", "pilots"]
    assert digits("ninety day fiance") == ["90", "day", "fiance"] and digits("twenty twelve") == ["20", "12"] and digits("twenty thirty one") == ["20", "31"]
    forms = lambda t: [(f.kind, f.form) for f in one(spark, text.compact_forms(F.lit(t)))]
    assert forms("the seven") == [(0, "theseven"), (1, "seven"), (2, "the7"), (3, "7")] and forms("red") == [(0, "red")]


def test_slips(spark):
    slip = lambda a, b: one(spark, text.slips(F.lit(a), F.lit(b)))
    assert all(slip("thigns", w) for w in ("things", "thins", "thigs", "thignss", "xhigns"))
    assert slip("sucesion", "succession") and slip("succession", "sucesion") and not slip("sucesion", "successsion")
    assert not slip("thigns", "thigns") and not slip("abc", "xyz") and not slip("abcd", "badc")


#: Labels and what they say, null for what says nothing.
GENRES = {
    "crime television series": "crime", "crime film": "crime", "crime fiction": "crime", "comedy anime and manga": "comedy", "drama film": "drama", "police procedural": "police procedural", "sitcom": "sitcom", "isekai": "isekai",
    "legal drama": "legal drama", "adult animated television series": "adult animation", "crime drama": "crime drama", "science fiction television series": "science fiction", "science fiction anime": "science fiction",
    "telenovela": "telenovela", "children's television series": "children's", "LGBT-related television series": "lgbtq", "Westerns on television": "western", "non-fiction film": "nonfiction",
    "post-apocalyptic television series": "post apocalyptic", "anime and manga": "anime", "reality television": "reality", "romance film": "romance", "romantic fiction": "romance", "police television drama": "police drama",
    "Japanese television drama": "japanese drama", "game show": "game show", "film noir": "noir", "anime-influenced animation": "anime influenced animation", "humour": "comedy", "speculative fiction": "speculative fiction",
    "television series": None, "television program": None, "genre of creative works": None, "work of art": None, "film": None, "fiction": None, "entertainment television program": None, "web series": None, "television serial": None,
}


def test_genres(spark):
    df = spark.createDataFrame(list(GENRES.items()), "label string, want string")
    wrong = df.withColumn("got", text.canonical_genre(F.col("label"))).where(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not wrong
    assert one(spark, text.canonical_genre(F.lit(None).cast("string"))) is None


def test_columns(spark):
    assert one(spark, text.cut_words(F.lit("one two three"), 9)) == "one two…" and one(spark, text.slug(F.lit("A b!c"))) == "a-b-c"
    assert one(spark, rows.birthplace(F.lit("Paris, France"), F.lit(None).cast("string"), F.lit("France"))) == "Paris, France"
    assert one(spark, ranking.percent_similar(F.lit(0.41))) == 60 and one(spark, ranking.percent_similar(F.lit(0.1))) is None


def test_clusters():
    near = np.array([[0, 0.9, 0, 0], [0.9, 0, 0, 0.1], [0, 0, 0, 0.5], [0, 0.1, 0.5, 0]])
    assert sorted(ranking.cluster(near)) == [[0, 1], [2, 3]]


def test_components(spark):
    got = sets.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_shows_and_publishing(spark, tmp_path):
    page = [{"id": 1, "name": "Red", "summary": "<p>Red &amp; blue " + "word " * 20 + "</p>", "premiered": "2001-02-03", "genres": ["Drama"], "network": {"id": 3, "name": "N", "country": {"code": "GB"}}, "runtime": 0, "averageRuntime": 45}, {"id": 2, "name": "Two", "genres": None, "premiered": None, "externals": {"imdb": "tt12345"}}]
    (tmp_path / "page-1.json").write_text(json.dumps(page))
    shows = tables.show_pages(spark, f"{tmp_path}/page-*.json")
    got = {r.id: r for r in tables.show_records(shows, "2026-01-01", ["Drama"], ["blue"]).collect()}
    assert (got[1].year, got[1].runtime, got[1].recommendable, got[1].genre_bits, got[1].theme_bits, got[1].country) == (2001, 45, True, 1, 1, "GB")
    assert not got[2].recommendable and got[2].coverage == "neither" and tables.channels(shows).first().channel == "network:3" and tables.external_ids(shows).first().id == 2
    version = tables.publish(shows.select("id"), str(tmp_path), "ids")
    assert tables.current(spark, str(tmp_path), "ids").count() == 2 and version
    try:
        tables.publish(shows.select("id"), str(tmp_path), "ids", [shows])
    except ValueError:
        assert tables.current(spark, str(tmp_path), "ids").count() == 2


def test_landed_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": {"bindings": [{"item": {"value": "http://x/Q1"}, "prop": {"value": "http://x/P2"}, "value": {"value": "http://x/Q9"}}, {"item": {"value": "http://x/Q1"}}]}}))
    assert [tuple(r) for r in tables.facts(tables.sparql_rows(spark, f"{tmp_path}/a.json"), {"P2": ("genre", 1.0)}).collect()] == [("Q1", "genre", "Q9", 1.0)]
    payload = json.dumps({"name": "N", "score": 11, "ratings": [{"region": "GB", "rating": "15"}], "providers": [{"id": 2, "kind": "rent", "priority": 1}, {"id": 5, "kind": "flatrate", "priority": 9}, {"id": 2, "kind": "flatrate", "priority": 3}]})
    r = tables.trimmed(spark.createDataFrame([(1, payload), (2, "no")], "id long, j string"), "id", "j", "GB").orderBy("id").collect()
    assert (r[0].score, r[0].rating, r[0].providers) == (None, "15", [2, 5]) and r[1].name is None and r[1].providers == []
