"""Title search over a made-up catalogue, where each tier can be seen on its own."""

import pytest

from quillon.operators import search

TITLES = {
    1: "Succession", 2: "Stranger Things", 3: "Breaking Bad", 4: "Law & Order: Special Victims Unit", 5: "How I Met Your Mother", 6: "The Wire", 7: "Brooklyn Nine-Nine", 8: "Demon Slayer", 9: "Game of Thrones", 10: "Grey's Anatomy",
    11: "Law & Order", 12: "Himym Street", 13: "911", 14: "Criminal Minds", 15: "Étoile noire",
}
ASKED = {
    "succession": (1, 1), "sucession": (1, 5), "sucesion": (1, 5), "stranger thigns": (2, 5), "stranger thign": (2, 5), "breaking bda": (3, 5), "law and order svu": (4, 6), "brooklyn 99": (7, 1), "nine one one": (13, 1), "the wirre": (6, 5),
    "demon slayer kimetsu no yaiba": (8, 7), "stranger things season 4": (2, 7), "greys anatomy": (10, 1), "minds criminal": (14, 3), "riminal mind": (14, 4), "etoile": (15, 2), "wire": (6, 1),
}
#: Searches that name nothing: initials of another title's words do not answer for the words beside them.
NOTHING = ["bb nothing at all", "got zebra", "zzzz"]


@pytest.fixture(scope="module")
def found(spark):
    titles = spark.createDataFrame([(k, t, False, 50, 7.0, 2000) for k, t in TITLES.items()], "id long, title string, alias boolean, known int, rating double, year int")
    queries = spark.createDataFrame(list(enumerate([*ASKED, *NOTHING, "himym"])), "query long, text string")
    texts = {r.query: r.text for r in queries.collect()}
    out = {t: [] for t in texts.values()}
    for r in sorted(search.find(queries, titles).collect(), key=lambda r: r.place):
        out[texts[r.query]].append((r.id, r.tier))
    return out


def test_each_tier_finds_its_title(found):
    assert {t: found[t][0] for t in ASKED} == ASKED


def test_nothing_is_found_by_part_of_the_words(found):
    assert all(not found[t] for t in NOTHING)


def test_a_title_the_letters_happen_to_start_does_not_hide_initials(found):
    assert found["himym"][0] == (12, 2) and not [x for x in found["himym"] if x[1] == 7]
