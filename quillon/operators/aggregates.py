"""Counts, shares and statistics of a catalogue, of lists and of episodes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered, running_total


def audit(df: DataFrame, by: Sequence[str], **flags: Column) -> DataFrame:
    """Total and count of each flag: one row over all, and one per value of each column in `by`; one pass."""
    aggs = [F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in flags.items())]
    sets = [[], *([c] for c in by)]
    named = df.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(c) for c in by]).agg(F.grouping_id().alias("level"), *aggs)
    return named


def prevalence(items: DataFrame, liked: DataFrame, key: str, feature: str) -> DataFrame:
    """Liked count, share, baseline share and lift of each feature. items: key, feature (one row per pair);
    liked: key. Shares are over the items with any feature row."""
    total = items.select(key).distinct().agg(F.count("*").alias("total"))
    mine = liked.select(key).distinct().join(items.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("liked_total"))
    marked = items.select(key, feature).distinct().join(liked.select(key).distinct().withColumn("is_liked", F.lit(1)), key, "left")
    counts = marked.groupBy(feature).agg(F.count("*").alias("baseline_count"), F.count("is_liked").alias("liked_count"))
    share, base = F.try_divide("liked_count", "liked_total"), F.try_divide("baseline_count", "total")
    return counts.join(F.broadcast(total)).join(F.broadcast(mine)).select(feature, "liked_count", "baseline_count", share.alias("share"), base.alias("baseline"), F.try_divide(share, base).alias("lift"))


def fit_shares(rated: DataFrame, group: str, feature: str, weight: str = "weight") -> DataFrame:
    """rated: group, item, weight, feature array (null: unknown). Weighted share of known items with each feature, as a
    whole percent, half up; zero shares are left out."""
    known = rated.where(F.col(feature).isNotNull())
    total = known.groupBy(group).agg(F.sum(weight).alias("total"))
    tally = known.select(group, weight, F.explode(F.array_distinct(feature)).alias("feature")).groupBy(group, "feature").agg(F.sum(weight).alias("mass"))
    return tally.join(total, group).withColumn("share", F.floor(F.round(F.try_divide("mass", "total") * 100, 9) + 0.5)).where("share > 0").select(group, "feature", "share")


def most_common(df: DataFrame, group: str, column: str) -> DataFrame:
    """The commonest known value of each group, ties to the larger value, with its count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col(column).alias("value"), "n"), F.struct("n", column))
    return counts.groupBy(group).agg(best.alias("b"), F.sum("n").alias("of")).select(group, "b.value", F.col("b.n").alias("count"), "of")


def breadth(df: DataFrame, group: str, **features: str) -> DataFrame:
    """Distinct values of array columns in each group."""
    return df.groupBy(group).agg(*(F.array_size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(name) for name, c in features.items()))


def rating_counts(ratings: DataFrame, group: str) -> DataFrame:
    """Loves, likes, OKs, neutrals, dislikes, liked and rated of each list, and its weight."""
    w = F.col("weight")
    return ratings.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(w == 1).alias("loves"), F.count_if(w == 0.7).alias("likes"), F.count_if(w == 0.35).alias("oks"), F.count_if(w == 0).alias("neutrals"),
        F.count_if(w < 0).alias("dislikes"), F.count_if(w > 0).alias("liked"), F.count_if(w != 0).alias("scored"), F.sum(F.when(w > 0, w).otherwise(0.0)).alias("liked_weight"),
    )


def phi(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of each two 0/1 columns from their counts; pairs without spread are left out."""
    pairs = list(combinations(names, 2))
    row = flags.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in names), *(F.sum(F.col(a) * F.col(b)).alias(f"b_{a}_{b}") for a, b in pairs))
    parts = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s_{a}").cast("double").alias("x"), F.col(f"s_{b}").cast("double").alias("y"), F.col(f"b_{a}_{b}").cast("double").alias("xy")) for a, b in pairs)))
    spread = F.sqrt(F.col("p.x") * (F.col("n") - F.col("p.x")) * F.col("p.y") * (F.col("n") - F.col("p.y")))
    return row.select("n", parts.alias("p")).where(spread > 0).select("p.a", "p.b", ((F.col("n") * F.col("p.xy") - F.col("p.x") * F.col("p.y")) / spread).alias("phi"))


def average_rank(value: Column, partition: Sequence[Column | str] = ()) -> Column:
    """Rank from 1, the mean rank for ties; null values have none but sort last, so give them their own partition."""
    order = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def spearman(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank correlation of each two columns over the rows where both are known, and how many those are.

    The pairs become rows of one table, so ranks are windows over (pair): one shuffle for all pairs."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(names, 2))))
    long = df.select(pairs.alias("p")).select("p.*").where("x is not null and y is not null")
    ranked = long.withColumn("rx", average_rank(F.col("x"), ["a", "b"])).withColumn("ry", average_rank(F.col("y"), ["a", "b"]))
    return ranked.groupBy("a", "b").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("pairs"))


def midrank(df: DataFrame, value: str) -> DataFrame:
    """The share of rows below a value plus half of those at it, for each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    below = running_total(counts, [value], "c", "below")
    return below.select(value, ((F.col("below") + F.col("c") / 2) / F.col("below_all")).alias("percentile"))


def index_quantile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The value at index int(q * (n - 1)) of each sorted group: neither interpolated nor the discrete percentile."""
    order = Window.partitionBy(group).orderBy(value)
    n = F.count("*").over(Window.partitionBy(group))
    ranked = df.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(order) - 1).alias("i"), n.alias("n"))
    return ranked.where(F.col("i") == F.floor(q * (F.col("n") - 1))).select(group, F.col(value).alias("quantile"))


def nearest_rank(df: DataFrame, group: str, value: str, qs: Sequence[float]) -> DataFrame:
    """sorted[min(n - 1, int(q * n))] for each q."""
    order = Window.partitionBy(group).orderBy(value)
    n = F.count("*").over(Window.partitionBy(group))
    ranked = df.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(order) - 1).alias("i"), n.alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(q * F.col("n"))), F.col(value)))
    return ranked.groupBy(group).agg(*(at(q).alias(f"p{round(q * 100)}") for q in qs))


def rank_share(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """1 for the first of each group down to 0 for the last, by score and then key."""
    order = Window.partitionBy(group).orderBy(F.desc(score), key)
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("share", F.coalesce(1 - F.try_divide(F.row_number().over(order) - 1, n - 1), F.lit(1.0)))


def episode_summary(episodes: DataFrame, show: str, aired: Column, season: str, runtime: str) -> DataFrame:
    """Aired episodes and distinct seasons of each show, and total minutes if every runtime is known."""
    e = episodes.where(aired)
    valid = F.coalesce(F.col(runtime) > 0, F.lit(False))
    return e.groupBy(show).agg(F.count("*").alias("episodes"), F.count_distinct(season).alias("seasons"), F.when(F.every(valid), F.sum(runtime)).alias("minutes"))


def season_averages(episodes: DataFrame, show: str, season: str, rating: str) -> DataFrame:
    """Mean of the rated episodes by season, and overall (season null) with every episode counting the same."""
    return episodes.groupingSets([[F.col(show), F.col(season)], [F.col(show)]], F.col(show), F.col(season)).agg(F.grouping(season).alias("overall"), F.avg(rating).alias("average"), F.count(rating).alias("rated"))


def credits(df: DataFrame, keys: Sequence[str], character: str, year: str, top: int = 2) -> DataFrame:
    """Episodes, first and last year, commonest characters, and whether every credit is the same kind."""
    named = df.groupBy(*keys, character).agg(F.count("*").alias("c"), F.min(year).alias("y0"), F.max(year).alias("y1"))
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col(character).isNotNull(), F.struct((-F.col("c")).alias("o"), F.col(character).alias("name"))))), 1, top), lambda x: x["name"])
    return named.groupBy(*keys).agg(F.sum("c").alias("episodes"), F.min("y0").alias("first_year"), F.max("y1").alias("last_year"), best.alias("characters"))


def hit_rates(ranks: DataFrame, by: Sequence[str], rank: str = "rank", at: Sequence[int] = (10, 24, 100)) -> DataFrame:
    """Hit rates, mean reciprocal rank (a missing rank adds 0) and the lower median rank, missing last; pooled over all
    (columns of `by` null, pooled 1) and by each of them."""
    far = F.coalesce(F.col(rank), F.lit((1 << 31) - 1))
    r = ranks.withColumn("_far", far)
    aggs = [F.avg((F.col("_far") <= k).cast("double")).alias(f"hr{k}") for k in at]
    return r.groupingSets([[], [F.col(c) for c in by]], *[F.col(c) for c in by]).agg(
        F.grouping(by[0]).alias("pooled"), F.count("*").alias("n"), *aggs, F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr"), F.nullif(F.expr("percentile_disc(0.5) within group (order by _far)"), F.lit((1 << 31) - 1)).alias("median_rank")
    )


def histogram_percentiles(df: DataFrame, value: str, width: float, qs: Sequence[float]) -> DataFrame:
    """Upper bounds of the histogram bins where the cumulated share reaches each q: one row."""
    bins = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("c"))
    cum = running_total(bins, ["bin"], "c")
    return cum.agg(*(F.min(F.when(F.col("before") + F.col("c") >= q * F.col("before_all"), (F.col("bin") + 1) * width)).alias(f"p{round(q * 100)}") for q in qs))


def combination_table(df: DataFrame, mask: str) -> DataFrame:
    """Each distinct mask once, with its code from 0 in order of mask and how many rows have it: what is computed for a
    mask is computed once and joined back."""
    return numbered(df.groupBy(mask).agg(F.count("*").alias("rows")), [mask], "code").withColumn("code", F.col("code").cast("long"))


def page_scores(hits: DataFrame, group: str, row: str, card: str, hit: str) -> DataFrame:
    """Of a page of rows of cards: hits in the first 3 and 8 rows and anywhere, distinct cards and repeats."""
    h = F.col(hit)
    return hits.groupBy(group).agg(
        F.max((h & (F.col(row) < 3)).cast("int")).alias("first_3"), F.max((h & (F.col(row) < 8)).cast("int")).alias("first_8"), F.max(h.cast("int")).alias("anywhere"),
        F.count_distinct(card).alias("distinct_cards"), (F.count("*") - F.count_distinct(card)).alias("repeats"), F.count_distinct(row).alias("rows"),
    )
