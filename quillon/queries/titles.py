"""Title search over the catalogue's names, for a stated set of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rows, search
from ..plans.stand_ins import SHOWS_SQL, shows
from ..sources.tables import table
from . import Query

SEARCHES = ((1, "red widget"), (2, "smal"), (3, "bo re"), (4, "the hot gear"), (5, "idget"), (6, "rde bolt"), (7, "blue boltt"), (8, "hg"), (9, "red something"), (10, "Ring of Blue"), (11, "wigdet gren"), (12, "buue gizo"), (13, "hotgear"), (14, "gad"), (15, "smal blod gadget parts"), (16, "sbe brand"), (17, "rbe"), (18, "smmall anvvil"), (19, "wiget standard new gear zebra"))
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{t}')" for k, t in SEARCHES) + ") v(query, text))"


def asked(spark):
    return spark.createDataFrame(list(SEARCHES), "query long, text string")


def titles(spark, d):
    """Each show by its name, and by a longer alias with its type and network."""
    long = F.concat_ws(" ", "name", F.lower("type"), F.lower("network"))
    names = F.explode(F.array(F.struct(F.col("name").alias("title"), F.lit(False).alias("alias")), F.struct(long.alias("title"), F.lit(True).alias("alias"))))
    return shows(spark, d).select("id", names.alias("t"), F.col("popularity").alias("known"), "rating", "year").select("id", "t.*", "known", "rating", "year")


def lines(spark, d):
    return search.title_lines(titles(spark, d))


def prepared(spark):
    return search.prepared(asked(spark))


def _tier(name):
    def run(spark, d):
        return getattr(search, name)(prepared(spark), lines(spark, d)).select("query", "id", F.col("tier").cast("long").alias("tier"))

    return run


def tiers_1_4(spark, d):
    q, t = prepared(spark), lines(spark, d)
    out = search.first_tiers([search.tier_exact(q, t), search.tier_prefix(q, t), search.tier_words(q, t), search.tier_inside(q, t)], titles(spark, d))
    return out.select("query", F.col("place").cast("long").alias("place"), "id", F.col("tier").cast("long").alias("tier"))


def typos(spark, d):
    return search.tier_typos(prepared(spark), lines(spark, d)).select("query", "id", F.col("slips").cast("long").alias("slips"))


def tiers_all(spark, d):
    return search.find(asked(spark), titles(spark, d)).select("query", F.col("place").cast("long").alias("place"), "id", F.col("tier").cast("long").alias("tier"))


def part_cover(spark, d):
    return search.tier_part(prepared(spark), lines(spark, d)).select("query", "id", F.round("cover", 3).alias("cover"))


def year_first(spark, d):
    q = asked(spark).withColumn("text", F.concat("text", F.lit(" 1999")))
    hits = search.first_tiers([search.tier_words(prepared(spark), lines(spark, d))], titles(spark, d), 500).join(q, "query")
    return search.year_first(hits.select("query", "text", "id", "place"), titles(spark, d)).select("query", "id", F.col("place").cast("long").alias("place"))


def study_search(spark, d):
    return search.contains_all(asked(spark), titles(spark, d).where("not alias"), "title").withColumn("place", F.col("place").cast("long"))


def phrases(spark, d):
    """Documents that hold a benchmark passage as whole words."""
    bench = table(spark, d, "benchmark").select("item_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(search.WORDS), F.lit(0)), " ").alias("phrase")).where("phrase <> ''")
    return search.phrase_hits(table(spark, d, "documents"), bench, "doc_id", "text").join(bench, "phrase").select("doc_id", "item_id")


def topic_names(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("label")).distinct()
    labels = words.select("label", F.lit(1).alias("source"), F.upper("label").alias("topic"))
    q = spark.createDataFrame([(1, "bolts"), (2, "Gear"), (3, "rings"), (4, "nothing")], "query long, text string")
    return search.topics(q, labels)


def just_added(spark, d):
    t = shows(spark, d).where("year >= 2015").select("id", F.col("name").alias("title"), (F.col("status") == "Running").alias("current")).na.fill(False)
    return search.just_added(asked(spark), t).select("query", F.col("place").cast("long").alias("place"), "id", F.col("tier").cast("long").alias("tier"))


def browse_sorts(spark, d):
    s, out = shows(spark, d), None
    for kind in ("popularity", "rating", "newest", "shortest", "name"):
        best = s.orderBy(*rows.sorted_by(s, kind)).limit(20).select(F.lit(kind).alias("sort"), "id")
        out = best if out is None else out.union(best)
    return out


_NORM = """qn AS (SELECT query, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM q),
qw AS (SELECT DISTINCT query, unnest(string_split(t, ' ')) AS w FROM qn), qc AS (SELECT query, count(*) AS n FROM qw GROUP BY query),
ls AS (SELECT id, name AS line FROM shows UNION SELECT id, trim(regexp_replace(lower(name || ' ' || type || ' ' || network), '[^a-z0-9]+', ' ', 'g')) FROM shows),
lw AS (SELECT DISTINCT id, line, unnest(string_split(line, ' ')) AS w FROM ls)"""
_FORMS = "qf AS (SELECT query, replace(t, ' ', '') AS f FROM qn UNION SELECT query, replace(substr(t, 5), ' ', '') FROM qn WHERE starts_with(t, 'the '))"
_LS = "ls AS (SELECT id, name AS line FROM shows), lw AS (SELECT DISTINCT id, line, unnest(string_split(line, ' ')) AS w FROM ls)"
_T1 = "SELECT DISTINCT qf.query, id, 1::BIGINT AS tier FROM qf JOIN ls ON qf.f = replace(line, ' ', '')"
_T2 = "SELECT DISTINCT qn.query, id, 2::BIGINT AS tier FROM qn JOIN ls ON length(replace(t, ' ', '')) > 1 AND starts_with(replace(line, ' ', ''), replace(t, ' ', ''))"
_T3 = "SELECT DISTINCT query, id, 3::BIGINT AS tier FROM (SELECT qw.query, id, line, count(DISTINCT qw.w) AS c FROM qw JOIN lw ON starts_with(lw.w, qw.w) GROUP BY ALL) JOIN qc USING (query) WHERE c = n"
_T4 = "SELECT DISTINCT query, id, 4::BIGINT AS tier FROM (SELECT qw.query, id, line, count(DISTINCT qw.w) AS c FROM qw JOIN lw ON starts_with(lw.w, qw.w) OR (length(qw.w) > 2 AND contains(lw.w, qw.w)) WHERE qw.query IN (SELECT query FROM qw WHERE length(w) > 2) GROUP BY ALL) JOIN qc USING (query) WHERE c = n"
#: Whether two words are one slip apart; letters doubled twice count as one.
_DOUBLES = "flatten([[substr({0}, 1, i) || substr({0}, i, 1) || substr({0}, i + 1, j - i) || substr({0}, j, 1) || substr({0}, j + 1) for j in range(i + 1, length({0}) + 1)] for i in range(1, length({0}) + 1)])"
_SLIP = "(damerau_levenshtein({0}, {1}) <= 1 OR list_contains(" + _DOUBLES.replace("{0}", "({0})") + ", {1}) OR list_contains(" + _DOUBLES.replace("{0}", "({1})") + ", {0}))"
_NEAR = f"""voc AS (SELECT DISTINCT w AS v FROM lw), ql AS (SELECT query, string_split(t, ' ')[-1] AS w FROM qn),
nr AS (SELECT query, w AS q, v FROM qw JOIN voc ON length(w) BETWEEN 3 AND 20 AND w <> v AND abs(length(w) - length(v)) <= 2 AND {_SLIP.format('w', 'v')}),
ty AS (SELECT query, w AS q, v FROM ql JOIN voc ON length(w) BETWEEN 4 AND 20 AND w[1] = v[1] WHERE len(list_filter(range(greatest(4, length(w) - 2), length(w) + 3), lambda k: k <= length(v) AND {_SLIP.format('w', 'v[1:k]')})) > 0),
ma AS (SELECT query, q, v, min(s) AS s FROM (SELECT query, q, v, 1 AS s FROM nr UNION ALL SELECT query, q, v, 1 FROM ty UNION ALL SELECT query, w, v, 0 FROM qw JOIN voc ON starts_with(v, w)) GROUP BY ALL),
tb AS (SELECT query, q, id, line, min(s) AS s FROM ma JOIN lw ON lw.w = v GROUP BY ALL),
tc AS (SELECT query, id, line, count(*) AS c, sum(s) AS slips FROM tb GROUP BY ALL),
t5 AS (SELECT query, id, min(slips)::BIGINT AS slips FROM tc JOIN qc USING (query) WHERE c = n AND slips > 0 GROUP BY ALL)"""
_INITIALS = f"""ii AS (SELECT id, line, array_to_string(list_transform(string_split(line, ' '), lambda x: x[1]), '') AS i FROM ls),
sw AS (SELECT query, qw.w, count(DISTINCT (id, line)) AS c FROM qw JOIN lw ON starts_with(lw.w, qw.w) GROUP BY ALL),
t6 AS (SELECT qw.query, ii.id, max(c IS NOT NULL) AS starts FROM qw LEFT JOIN sw ON sw.query = qw.query AND sw.w = qw.w JOIN ii ON contains(i, qw.w) JOIN qn ON qn.query = qw.query
       WHERE regexp_full_match(qw.w, '[a-z0-9]{{3,6}}') AND coalesce(c, 0) <= {search.BROAD}
       AND len(list_filter(string_split(t, ' '), lambda r: r <> qw.w AND len(list_filter(string_split(line, ' '), lambda x: starts_with(x, r))) = 0)) = 0 GROUP BY ALL)"""
_PART = f"""nl AS (SELECT count(*) AS n FROM ls), dfs AS (SELECT w, count(*) AS df FROM lw GROUP BY w),
ask AS (SELECT qw.query, qw.w AS q, df, ln((nl.n + 1)::DOUBLE / (coalesce(df, 0) + 1)) AS a FROM qw LEFT JOIN dfs ON dfs.w = qw.w JOIN qc ON qc.query = qw.query, nl WHERE qc.n > 1),
pm AS (SELECT query, q, q AS v FROM ask WHERE df IS NOT NULL UNION SELECT query, q, v FROM nr JOIN ask USING (query, q) WHERE df IS NULL AND length(q) > 4),
pb AS (SELECT pm.*, sum(df) OVER (PARTITION BY query, q) AS brings FROM pm JOIN dfs ON dfs.w = v),
po AS (SELECT DISTINCT query, id, line FROM pb JOIN lw ON lw.w = v WHERE brings <= {search.BROAD}),
px AS (SELECT query, id, line, unnest(string_split(line, ' ')) AS w FROM po),
py AS (SELECT query, id, line, sum(h) AS whole, sum(CASE WHEN w IN (SELECT v FROM pm WHERE pm.query = z.query) THEN h ELSE 0 END) AS both_ FROM (SELECT query, id, line, px.w, ln((n + 1)::DOUBLE / (df + 1)) AS h FROM px JOIN dfs ON dfs.w = px.w, nl) z GROUP BY ALL),
pq AS (SELECT query, id, line, sum(a) AS mine FROM (SELECT DISTINCT px.query, id, line, pm.q FROM px JOIN pm ON pm.query = px.query AND pm.v = px.w) JOIN ask USING (query, q) GROUP BY ALL),
pt AS (SELECT query, sum(a) AS total FROM ask GROUP BY query),
pr AS (SELECT query, id, both_ / nullif(whole, 0) AS a, mine / nullif(total, 0) AS b FROM py JOIN pq USING (query, id, line) JOIN pt USING (query)),
t7 AS (SELECT query, id, max(round(round(2 * a * b / (a + b), 9), 3)) AS cover FROM pr WHERE round(a, 9) >= 0.5 AND round(b, 9) >= 0.25 GROUP BY ALL)"""
_HEAD = f"WITH {SHOWS_SQL}, {_Q}, {_NORM}, {_FORMS}"
_RANK = "row_number() OVER (PARTITION BY query ORDER BY tier, popularity DESC, coalesce(rating, 0) DESC, coalesce(year, 0) DESC, m.id)"
_BEST = f"r AS (SELECT query, m.id, tier, {_RANK} AS place FROM m JOIN shows ON shows.id = m.id) SELECT * FROM r WHERE place <= 12"

QUERIES = [
    Query("search_tier_exact", _tier("tier_exact"), f"{_HEAD} {_T1}"),
    Query("search_tier_prefix", _tier("tier_prefix"), f"{_HEAD} {_T2}"),
    Query("search_tier_words", _tier("tier_words"), f"{_HEAD} {_T3}"),
    Query("search_tier_inside", _tier("tier_inside"), f"{_HEAD} {_T4}"),
    Query("search_typos", typos, f"{_HEAD}, {_NEAR} SELECT query, id, slips FROM t5"),
    Query("search_initials", _tier("tier_initials"), f"{_HEAD}, {_INITIALS} SELECT query, id, 6::BIGINT AS tier FROM t6"),
    Query("search_part", part_cover, f"{_HEAD}, {_NEAR}, {_PART} SELECT query, id, cover FROM t7"),
    Query("search_tiers_1_4", tiers_1_4, f"{_HEAD}, u AS ({_T1} UNION ALL {_T2} UNION ALL {_T3} UNION ALL {_T4}), m AS (SELECT query, id, min(tier) AS tier FROM u GROUP BY ALL), {_BEST}"),
    Query("search_tiers_all", tiers_all, f"{_HEAD}, {_NEAR}, {_INITIALS}, {_PART}, st AS ({_T1} UNION ALL {_T2} UNION ALL {_T3}), se AS (SELECT DISTINCT query FROM st), u AS (SELECT * FROM st UNION ALL {_T4} UNION ALL SELECT query, id, 5 FROM t5 WHERE query NOT IN (SELECT query FROM se) UNION ALL SELECT query, id, 6 FROM t6 WHERE NOT starts OR query NOT IN (SELECT query FROM se) UNION ALL SELECT query, id, 7 FROM t7 WHERE query NOT IN (SELECT query FROM se)), m AS (SELECT query, id, min(tier) AS tier FROM u GROUP BY ALL), {_BEST}"),
    Query("search_year_first", year_first, f"{_HEAD}, m AS ({_T3}), r AS (SELECT query, m.id, year, {_RANK} AS p FROM m JOIN shows ON shows.id = m.id) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN year = 1999 THEN 0 ELSE 1 END, p) AS place FROM r WHERE p <= 500"),
    Query("search_study", study_search, f"WITH {SHOWS_SQL}, {_Q}, h AS (SELECT query, lower(text) AS t, id, name, popularity FROM q JOIN shows ON len(list_filter(string_split(lower(text), ' '), lambda w: NOT contains(name, w))) = 0), r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN starts_with(name, t) THEN 0 ELSE 1 END, popularity DESC, length(name), id) AS place FROM h) SELECT query, place, id FROM r WHERE place <= 10"),
    Query("phrase_hits", phrases, "WITH b AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') AS p FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id, item_id FROM d JOIN b ON p <> '' AND contains(t, ' ' || p || ' ')"),
    Query("search_topics", topic_names, "WITH q AS (SELECT * FROM (VALUES (1::BIGINT, 'bolts'), (2::BIGINT, 'gear'), (3::BIGINT, 'rings'), (4::BIGINT, 'nothing')) v(query, t)), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT query, min(upper(w)) AS topic FROM q JOIN w ON t IN (w, w || 's') GROUP BY query"),
    Query("search_just_added", just_added, f"WITH {SHOWS_SQL.replace(' FROM part)', ' FROM part WHERE CAST(1950 + p_partkey % 75 AS INT) >= 2015)')}, {_Q}, {_NORM.split('ls AS')[0]} {_LS}, {_FORMS}, u AS ({_T1} UNION ALL {_T2} UNION ALL {_T3}), m AS (SELECT query, id, min(tier) AS tier FROM u GROUP BY ALL) SELECT query, m.id, tier, row_number() OVER (PARTITION BY query ORDER BY tier, coalesce(status = 'Running', false) DESC, m.id) AS place FROM m JOIN shows ON shows.id = m.id"),
    Query("browse_sorts", browse_sorts, f"WITH {SHOWS_SQL} SELECT 'popularity' AS sort, id FROM (SELECT id FROM shows ORDER BY popularity DESC, id LIMIT 20) UNION ALL SELECT 'rating', id FROM (SELECT id FROM shows ORDER BY rating DESC NULLS LAST, popularity DESC, id LIMIT 20) UNION ALL SELECT 'newest', id FROM (SELECT id FROM shows ORDER BY year DESC, popularity DESC, id LIMIT 20) UNION ALL SELECT 'shortest', id FROM (SELECT id FROM shows ORDER BY runtime, popularity DESC, id LIMIT 20) UNION ALL SELECT 'name', id FROM (SELECT id FROM shows ORDER BY lower(name), id LIMIT 20)"),
]
