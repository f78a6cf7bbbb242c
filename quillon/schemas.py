"""Schemas of the tables that the library reads and writes."""

SHOW = (
    "id long, name string, type string, language string, genres array<string>, status string, premiered string, ended string, runtime int, averageRuntime int, "
    "rating struct<average: double>, weight int, network struct<id: long, name: string, country: struct<code: string>>, webChannel struct<id: long, name: string, country: struct<code: string>>, "
    "externals struct<imdb: string, thetvdb: long>, image struct<medium: string>, summary string, url string"
)
CATALOGUE = (
    "id long, name string, year int, premiered string, runtime int, rating double, genres array<string>, status string, language string, type string, country string, "
    "channel string, url string, summary string, summary_words int, genre_bits long, theme_bits long, recommendable boolean, coverage string"
)
MATRIX = "row long, col long, value double"
EDGES = "a long, b long, s double"
NEIGHBOURS = "i long, rank int, j long, near double, text double, bonus double"
CLICKS = "month string, a long, b long, n long"
TRIPLES = "item string, prop string, value string"
PROFILE = "user_id long, pos int, item long, weight double"
EPISODES = "id long, show_id long, season int, number int, rating double, votes int, airdate string, airstamp string, runtime int"
