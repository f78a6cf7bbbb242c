"""Micro-genres of an interest: combinations of a subject with a form, place, adjective and era that its shows share more
often than shows in general, mined level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .rows import row_title

#: The parts of a name, in the order in which a combination grows; it always has a core.
ROLES = ("core", "form", "place", "adjective", "era")


def frequent(parts: DataFrame, group: str, key: str, least: int) -> DataFrame:
    """parts: group, key, role, words. group, the roles as columns (null: not in it), support: all combinations of a core and
    at most one part of each other role that at least `least` keys of the group have.

    Level by level: only a frequent combination grows, and only by a part that is frequent with its core, so what is
    counted at a level are the holders of what the level before kept. Repeated rows count once, null words never."""
    parts = materialise(parts.where("words IS NOT NULL").select(group, key, "role", "words").distinct())
    level = parts.where("role = 'core'").select(group, key, F.col("words").alias("core"), *(F.lit(None).cast("string").alias(r) for r in ROLES[1:]))
    level, pairs, found = _kept(level, group, least), None, []
    for k in range(len(ROLES)):
        found.append(level.groupBy(group, *ROLES).agg(F.count("*").alias("support")))
        if k == len(ROLES) - 1:
            break
        grown = []
        for n, role in enumerate(ROLES[1:], 1):
            later = [F.col(r).isNull() for r in ROLES[n:]]
            more = parts.where(F.col("role") == role).select(group, key, F.col("words").alias("_words"))
            open_ = level.where(reduce(lambda a, b: a & b, later))
            if pairs is not None:
                more_of = pairs.where(F.col("role") == role).select(group, "core", F.col("words").alias("_words"))
                step = open_.join(more, [group, key]).join(more_of, [group, "core", "_words"], "left_semi")
            else:
                step = open_.join(more, [group, key])
            grown.append(step.select(group, key, *(F.col("_words").alias(r) if r == role else F.col(r) for r in ROLES)))
        level = _kept(reduce(DataFrame.unionByName, grown), group, least)
        if pairs is None:
            pair = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("words")) for r in ROLES[1:])))
            pairs = materialise(level.select(group, "core", pair.alias("p")).select(group, "core", "p.*").where("words IS NOT NULL").distinct())
    return reduce(DataFrame.unionByName, found)


def _kept(holders: DataFrame, group: str, least: int) -> DataFrame:
    """The holders of the combinations that enough keys hold."""
    holders = materialise(holders)
    often = holders.groupBy(group, *ROLES).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    same = reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (group, *ROLES)])
    return materialise(holders.alias("h").join(often.alias("o"), same, "left_semi"))


def held_by(parts: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """wanted: the roles as columns, distinct. Those with how many keys of all parts (key, role, words) hold each: a key gives
    its own combinations, few, never pairs with all that are wanted."""
    own = parts.where("words IS NOT NULL").groupBy(key).agg(*(F.collect_set(F.when(F.col("role") == r, F.col("words"))).alias(r) for r in ROLES))
    for r in ROLES[1:]:
        own = own.withColumn(r, F.explode(F.array_append(F.col(r), F.lit(None).cast("string"))))
    own = own.withColumn("core", F.explode("core")).select(*ROLES)
    same = reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ROLES])
    kept = own.alias("h").join(wanted.select(*ROLES).alias("o"), same, "left_semi")
    return kept.groupBy(*ROLES).agg(F.count("*").alias("shows"))


def recipes(members: DataFrame, parts: DataFrame, catalogue: int, least: int = 2, niche: int = 12, lift: float = 1.5, words: int = 5, most: int = 6) -> DataFrame:
    """interest, place, name, support, shows, lift: the micro-genres of each interest, strongest first.

    members: interest, id; parts: id, role, words, of the whole catalogue of so many shows. A recipe stands for at least
    `least` members and `niche` shows, is `lift` times as frequent among the members as among all shows, and its name has at
    most `words` words, an era's "from the" aside. Strength is the support times the logarithm of the lift; of equal names,
    and of equal strength, the name decides. Interests of shows without parts have none; empty tables give no rows."""
    n = members.groupBy("interest").agg(F.count_distinct("id").alias("members"))
    own = members.select("interest", "id").distinct().join(parts, "id")
    found = materialise(frequent(own, "interest", "id", least))
    counted = materialise(held_by(parts, "id", found.select(*ROLES).distinct()))
    same = reduce(lambda a, b: a & b, [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ROLES])
    r = found.alias("f").join(counted.alias("c"), same).select("f.*", "c.shows").join(n, "interest").where(F.col("shows") >= niche)
    r = r.withColumn("lift", (F.col("support") / F.col("members")) / (F.col("shows") / catalogue)).where(F.col("lift") >= lift - 1e-9)
    r = r.withColumn("name", row_title(F.col("adjective"), F.col("place"), F.col("core"), F.col("form"), F.col("era")))
    r = r.where(F.size(F.split(F.regexp_replace("name", " from the ", " "), " ")) <= words)
    r = r.withColumn("strength", F.round(F.col("support") * F.log("lift"), 9))
    r = r.withColumn("same", F.row_number().over(Window.partitionBy("interest", "name").orderBy(F.desc("strength"), *ROLES))).where("same = 1")
    place = F.row_number().over(Window.partitionBy("interest").orderBy(F.desc("strength"), "name"))
    return r.withColumn("place", place).where(F.col("place") <= most).select("interest", "place", "name", "support", "shows", "lift")
