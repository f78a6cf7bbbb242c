"""The whole recommendation: from rating lists and the model's tables to explained picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, ranking, taste
from ..operators.filters import Settings, eligible
from ..sources.tables import materialise


def scored_candidates(catalogue: DataFrame, ratings: DataFrame, links: DataFrame, attributes: DataFrame, base: DataFrame, settings: Settings) -> DataFrame:
    """user_id, id, interest, score of the eligible shows that some liked show of a list links to. links: a, b, near.

    Shows without a link to a liked show score zero, so the pool is never spelled out as users times catalogue."""
    liked = ratings.where("weight > 0").select("user_id", "pos", "id", "weight")
    disliked = ratings.where("weight < 0").select("user_id", "id")
    grouped = materialise(liked.join(ranking.interests(liked, links), ["user_id", "id"]))
    reached = grouped.select("user_id", F.col("id").alias("a")).join(links, "a").select("user_id", F.col("b").alias("id")).distinct()
    pool = materialise(reached.join(catalogue.where(eligible(settings)).select("id"), "id", "left_semi").join(ratings.select("user_id", "id"), ["user_id", "id"], "left_anti"))
    parts = taste.categorical_scores(pool, attributes, taste.categorical_contributions(taste.list_ratios(ratings, attributes, base), base))
    tasted = pool.join(taste.taste_score(parts), ["user_id", "id"], "left").join(catalogue.select("id", "rating"), "id")
    factors = tasted.select("user_id", "id", taste.factor(F.col("taste"), F.col("rating")).alias("factor"))
    hits = ranking.interest_hits(pool, grouped, links, settings.closest)
    return ranking.scores(hits, ranking.penalties(pool, disliked, links, settings.dislike), factors, grouped)


def recommend(catalogue: DataFrame, ratings: DataFrame, links: DataFrame, attributes: DataFrame, base: DataFrame, settings: Settings | None = None, top: int = 24) -> DataFrame:
    """user_id, rank, id, interest, score, because: the picks of each list and the liked show each is closest to. Lists, links
    and picks are used many times over, so they are written once."""
    ratings, links = materialise(ratings), materialise(links)
    picked = materialise(ranking.picks(scored_candidates(catalogue, ratings, links, attributes, base, settings or Settings()), top))
    grouped = ratings.where("weight > 0").join(ranking.interests(ratings.where("weight > 0"), links), ["user_id", "id"])
    source = ranking.closest_source(picked, grouped.select("user_id", "interest", "id", "pos", "weight"), links)
    return picked.join(source, ["user_id", "id"], "left")


def explained(catalogue: DataFrame, ratings: DataFrame, links: DataFrame, attributes: DataFrame, base: DataFrame, signals: DataFrame, settings: Settings | None = None, top: int = 24) -> DataFrame:
    """The picks of `recommend` with what explains them. signals: id, themes, genres (arrays). Adds the pick's themes and
    genres, those that its closest liked show has too (shared_themes, shared_genres), penalised (percent), the liked shows
    that stand beside the picks (liked) and how close the pick is to each of them (links, percent)."""
    settings = settings or Settings()
    ratings, links = materialise(ratings), materialise(links)
    picked = materialise(recommend(catalogue, ratings, links, attributes, base, settings, top))
    liked = ratings.where("weight > 0").select("user_id", "id", "pos", "weight")
    penalty = ranking.penalties(picked, ratings.where("weight < 0").select("user_id", "id"), links, settings.dislike)
    out = explain.linked_liked(explain.shared_signals(picked, signals), liked, links)
    return out.join(penalty, ["user_id", "id"], "left").withColumn("penalised", explain.penalised(F.col("penalty"))).drop("penalty")


def profile(catalogue: DataFrame, ratings: DataFrame, features: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """What each list is made of: its features against the shows it could be given (features: id, group, name), and the
    commonest language, type and network of its liked shows."""
    pool = catalogue.where(eligible(settings or Settings()))
    return explain.list_features(ratings, pool, features, ["group", "name"]), explain.list_context(ratings.where("weight > 0"), catalogue)
