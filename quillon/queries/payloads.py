"""Provider payloads: JSON made of the driver's tables, with values of wrong types in it, read back by the typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stand_ins import SHOWS_SQL, shows
from ..sources import payloads
from ..sources.tables import art_track, manifest, shared_folder, table
from . import Query

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


def lines(spark: SparkSession, d: str, entry: str, key: str, body: str) -> DataFrame:
    """One payload an order: entry (an SQL text of each line) in the order of lines, put into body in place of @. Every seventh
    payload does not parse."""
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "), F.expr(entry).alias("entry")))).alias("e"))
    joined = F.concat_ws(", ", F.transform("e", lambda x: x["entry"]))
    before, after = body.split("@")
    text = F.concat(F.expr(before), joined, F.expr(after))
    return each.select(F.col("l_orderkey").alias(key), F.when(F.col("l_orderkey") % 7 == 0, "{broken").otherwise(text).alias("json"))


def payload_episodes(spark, d):
    name = "CASE l_linenumber % 4 WHEN 0 THEN '5' ELSE concat('\"Part ', l_linenumber, '\"') END"
    average = "CASE WHEN l_linenumber % 5 = 0 THEN '\"8\"' WHEN l_linenumber % 3 = 0 THEN 'null' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
    entry = f"""concat('{{"id": ', l_partkey, ', "season": ', l_suppkey % 3, ', "number": ', l_linenumber, CASE WHEN l_linenumber = 6 THEN '.0' ELSE '' END, ', "name": ', {name},
        ', "runtime": ', CASE WHEN l_suppkey % 2 = 0 THEN '45' ELSE '45.5' END, ', "rating": {{"average": ', {average}, '}}, "airdate": "', CASE WHEN l_suppkey % 5 = 0 THEN 'soon' ELSE date_format(l_shipdate, 'yyyy-MM-dd') END, '"}}')"""
    out = payloads.episodes(lines(spark, d, entry, "show", "'[7, '@', \"none\"]'"), "show", "json")
    return out.select("show", F.col("place").cast("long").alias("place"), "id", "season", "number", "name", "runtime", "rating", "airdate", "airstamp")


def payload_credits(spark, d):
    entry = """concat('{"self": ', CASE WHEN l_returnflag = 'R' THEN 'true' ELSE '"true"' END, ', "type": "', CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE concat('Writer  ', l_linestatus) END, '", "_links": {"show": {"href": "https://api.example/shows/', l_partkey,
        CASE WHEN l_linenumber = 2 THEN '/cast' ELSE '' END, '", "name": "Show ', l_partkey, '"}', CASE WHEN l_linenumber % 2 = 0 THEN ', "character": {"name": 7}' ELSE concat(', "character": {"name": "Role ', l_linenumber, '"}') END, '}}')"""
    body = """concat('{"id": ', l_orderkey, ', "name": "P", "_embedded": {"crewcredits": {}, "castcredits": [')@']}}'"""
    crew = body.replace("crewcredits", "x").replace("castcredits", "crewcredits")
    both = lines(spark, d, entry, "person", body).where("person % 3 > 0").union(lines(spark, d, entry, "person", crew).where("person % 3 = 0"))
    return payloads.credits(both, "json").withColumn("place", F.col("place").cast("long"))


def payload_videos(spark, d):
    """Fifteen videos and a trailer a show: keys that repeat, keys of a wrong length, kinds that are no texts."""
    video = """concat('{"youtube_video_id": "', lpad(CAST(id AS STRING), 8, '0'), '-', lpad(CAST(k % 10 AS STRING), CASE WHEN k = 3 THEN 1 ELSE 2 END, '0'), '", "title": ', CASE WHEN k % 4 = 1 THEN '1' ELSE concat('"Clip ', k, '"') END,
        ', "categories": [', CASE WHEN k % 3 = 0 THEN '1, "Teaser", "Clip"' ELSE '2' END, '], "published": "', 2000 + k, '-01-02T03:04"}')"""
    listed = F.concat_ws(", ", F.expr(f"transform(sequence(0, 14), k -> {video})"))
    trailer = F.when(F.col("id") % 3 == 0, F.expr("transform(array(4), k -> " + video + ")[0]")).otherwise(F.lit('"none"'))
    body = F.concat(F.lit('{"trailer": '), trailer, F.lit(', "videos": [null, '), listed, F.lit("]}"))
    out = payloads.videos(shows(spark, d).select("id", body.alias("json")), "id", "json")
    return out.withColumn("place", F.col("place").cast("long"))


def payload_ratings(spark, d):
    """Age ratings and store links of shows by searches for their names: namesakes, other years, unknown ratings."""
    ages = "array(" + ", ".join(f"'{a}'" for a in (*payloads.AGES, "Unrated")) + ")"
    season = f"""concat('{{"artistName": "', CASE WHEN k = 5 THEN 'Another' ELSE concat(upper(name), '!') END, '", "contentAdvisoryRating": "', {ages}[CAST((id * k + k DIV 2) % 7 AS INT)], '", "collectionName": "', name,
        CASE WHEN id % 4 = 0 THEN ', Box' ELSE concat(', Season ', 6 - k) END, '", "releaseDate": "', year + CAST((id * (k + 1)) % 9 AS INT) - 2, '-05-01", "collectionViewUrl": "', CASE WHEN (id + k) % 3 = 0 THEN 'https://other.example/' ELSE 'https://store.example/' END, id, '-', k, '"}}')"""
    s = shows(spark, d).select("id", "name", "year")
    body = F.concat(F.lit('{"results": ['), F.concat_ws(", ", F.expr(f"transform(sequence(0, 5), k -> {season})")), F.lit(', 3, {"artistName": null}]}'))
    found = payloads.store_seasons(s.select("id", body.alias("json")), "id", "json", ["https://store.example/"])
    runs = s.select("id", "name", F.when(F.col("id") % 5 > 0, F.col("year")).alias("start"), F.when(F.col("id") % 3 > 0, F.col("year") + 3).alias("end"))
    return payloads.store_ratings(found, runs, "id")


def art_years(spark, d):
    """Images and ended years of shows that ended on a day, in a year, at no known time, or never."""
    s = shows(spark, d)
    ended = F.expr("CASE id % 4 WHEN 0 THEN concat(year + 3, '-12-31') WHEN 1 THEN CAST(year AS STRING) WHEN 2 THEN 'soon' END")
    images = s.where("id % 5 > 0").select("id", F.concat(F.lit("https://art.example/"), F.floor(F.col("id") / 2500).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg")).alias("url"), ended.alias("until"))
    return art_track(s, images, "id", "url", ended="until").withColumn("ended", F.col("ended").cast("long"))


def landed_manifest(spark, d):
    """Length and hash of landed pages: a file a nation, its customers' names in order."""
    folder = shared_folder(spark)
    names = table(spark, d, "customer").where("c_custkey is not null").select((F.col("c_custkey") % 25).alias("page"), "c_custkey", "c_name")
    bodies = names.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "\n").alias("value"))  # one of 25 pages a row
    bodies.repartition(25, "page").write.partitionBy("page").option("lineSep", "\n").text(folder)
    files = manifest(spark, f"{folder}/page=*/*.txt")
    return files.select(F.regexp_extract("path", r"page=(\d+)/", 1).cast("long").alias("page"), "length", "sha256")


_AT = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER})"
_CREDIT = """SELECT l_orderkey AS person, '{kind}' AS kind, l_partkey AS show, 'Show ' || l_partkey AS show_name, {part} AS part, l_returnflag = 'R' AS self, false AS voice, pos FROM l WHERE l_orderkey % 3 {third} AND l_linenumber <> 2 {where}"""
_AGE_LIST = "[" + ", ".join(f"'{a}'" for a in (*payloads.AGES, "Unrated")) + "]"

QUERIES = [
    Query("payload_episodes", payload_episodes, f"""WITH l AS (SELECT *, {_AT} AS pos FROM lineitem),
v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY pos) AS n FROM l WHERE l_orderkey % 7 > 0 AND l_linenumber % 4 > 0 AND l_linenumber <> 6 AND l_suppkey % 3 > 0 AND l_partkey <> 0)
SELECT l_orderkey AS show, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, l_linenumber, l_partkey) AS place, l_partkey AS id, l_suppkey % 3 AS season, l_linenumber::BIGINT AS number, 'Part ' || l_linenumber AS name, CASE WHEN l_suppkey % 2 = 0 THEN 45::BIGINT END AS runtime,
  CASE WHEN l_linenumber % 5 > 0 AND l_linenumber % 3 > 0 AND l_quantity::INT BETWEEN 1 AND 10 THEN (l_quantity::INT)::DOUBLE END AS rating, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS airdate, '' AS airstamp FROM v WHERE n = 1"""),
    Query("payload_credits", payload_credits, f"""WITH l AS (SELECT *, {_AT} AS pos FROM lineitem WHERE l_orderkey % 7 > 0),
c AS ({_CREDIT.format(kind='cast', third='> 0', where='', part="CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'Role ' || l_linenumber END")} UNION ALL {_CREDIT.format(kind='crew', third='= 0', where='AND l_suppkey % 4 > 0', part="'Writer ' || l_linestatus")})
SELECT person, kind, "show", show_name, part, self, voice, row_number() OVER (PARTITION BY person, kind ORDER BY pos) AS place FROM c"""),
    Query("art_years", art_years, f"WITH {SHOWS_SQL} SELECT id, CASE WHEN id % 5 > 0 THEN id ELSE 0 END AS image, (CASE WHEN id % 5 = 0 THEN 0 WHEN id % 4 = 0 THEN year + 3 WHEN id % 4 = 1 THEN year ELSE 0 END)::BIGINT AS ended FROM shows"),
    Query("landed_manifest", landed_manifest, "WITH f AS (SELECT c_custkey % 25 AS page, string_agg(c_name, chr(10) ORDER BY c_custkey, c_name) || chr(10) AS body FROM customer GROUP BY ALL) SELECT page, octet_length(encode(body)) AS length, sha256(body) AS sha256 FROM f"),
    Query("payload_videos", payload_videos, f"""WITH {SHOWS_SQL}, k AS (SELECT unnest(range(15)) AS k), v AS (SELECT id, k, k AS pos FROM shows, k WHERE k <> 3 UNION ALL SELECT id, 4, -1 FROM shows WHERE id % 3 = 0),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, k % 10 ORDER BY pos) = 1)
SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS place, lpad(id::VARCHAR, 8, '0') || '-' || lpad((k % 10)::VARCHAR, 2, '0') AS video, CASE WHEN k % 4 = 1 THEN '' ELSE 'Clip ' || k END AS title, CASE WHEN k % 3 = 0 THEN 'Teaser' ELSE 'Video' END AS kind, (2000 + k) || '-01-02' AS published FROM o) WHERE place <= 12"""),
    Query("payload_ratings", payload_ratings, f"""WITH {SHOWS_SQL}, h AS (SELECT id, k, year + (id * (k + 1)) % 9 - 2 AS y, (id * k + k // 2) % 7 + 1 AS age, (id + k) % 3 > 0 AS linked FROM shows, (SELECT unnest(range(5)) AS k)
  WHERE year + (id * (k + 1)) % 9 - 2 BETWEEN CASE WHEN id % 5 > 0 THEN year ELSE 0 END - 1 AND CASE WHEN id % 3 > 0 THEN year + 3 ELSE 9999 END + 1 AND (id * k + k // 2) % 7 < 6),
a AS (SELECT id, age, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, age DESC) AS n FROM h GROUP BY id, age),
u AS (SELECT id, first('https://store.example/' || id || '-' || k ORDER BY CASE WHEN id % 4 = 0 THEN -y ELSE 6 - k END, CASE WHEN id % 4 = 0 THEN k ELSE y END) AS link FROM h WHERE linked GROUP BY id)
SELECT a.id, {_AGE_LIST}[age] AS rating, link FROM a LEFT JOIN u ON u.id = a.id WHERE n = 1"""),
]
