"""What is landed as files and published as versions: each query writes its input in the form it lands in, into the shared
folder, and reads it with the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, dates, text
from ..operators import checks, client, evaluate, filters, rows, search, sequences, sets
from ..plans.stand_ins import RATINGS_SQL, SHOWS_SQL, ratings, shows
from ..sources import tables
from ..sources.tables import table
from ..streaming import streams
from . import Query

GENRES = ("red", "blue", "small", "hot", "widget", "gear", "bolt", "ring")
THEMES = (r"\bwar\b", r"\bspace\b", r"\bcook\w*")


def landed(df: DataFrame, page: str, body: str) -> str:
    """Write a JSON document (column body) for each page, a file each."""
    folder = tables.shared_folder(df.sparkSession)
    df.select(page, body).write.partitionBy(page).text(folder)
    return folder


def raw_shows(spark: SparkSession, d: str) -> DataFrame:
    """Shows as a provider's pages have them, 250 ids a page."""
    country = "named_struct('code', CASE WHEN p_partkey % 2 = 0 THEN 'GB' END)"
    show = f"""named_struct('id', p_partkey, 'name', p_name, 'type', p_type, 'language', CASE WHEN p_partkey % 3 > 0 THEN 'English' END, 'genres', split(p_name, ' '), 'status', 'Ended',
        'premiered', CASE WHEN p_partkey % 17 > 0 THEN concat(1950 + p_partkey % 75, '-03-01') END, 'runtime', CAST(p_size AS INT), 'averageRuntime', CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 45 END AS INT), 'rating', named_struct('average', 5 + p_partkey % 50 / 10),
        'network', CASE WHEN p_partkey % 3 > 0 THEN named_struct('id', CAST(p_size AS LONG), 'name', p_brand, 'country', {country}) END,
        'webChannel', CASE WHEN p_partkey % 5 = 0 THEN named_struct('id', p_partkey % 7, 'name', 'Web', 'country', {country}) END,
        'externals', named_struct('imdb', CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE concat('tt', lpad(p_partkey, 7, '0')) END),
        'summary', concat('<p>The ', p_name, ' &amp; the ', p_name, 's: war in space, ', repeat('word ', CAST(p_partkey % 20 AS INT)), '</p>'), 'url', concat('https://shows.example/', p_partkey))"""
    pages = table(spark, d, "part").selectExpr("p_partkey div 250 AS page", f"{show} AS show").groupBy("page").agg(F.to_json(F.collect_list("show")).alias("body"))
    return tables.show_pages(spark, landed(pages, "page", "body"))


def show_records(spark, d):
    out = tables.show_records(raw_shows(spark, d), "2010-06-01", GENRES, THEMES)
    return out.select("id", F.col("year").cast("long").alias("year"), F.col("runtime").cast("long").alias("runtime"), F.round("rating", 6).alias("rating"), "country", "channel", "summary", F.col("summary_words").cast("long").alias("summary_words"), "genre_bits", "theme_bits", "recommendable", "coverage")


def show_channels(spark, d):
    return tables.channels(raw_shows(spark, d))


def external_ids(spark, d):
    return tables.external_ids(raw_shows(spark, d))


def show_forms(spark, d):
    kinds = F.element_at(F.array(F.lit("Scripted"), F.lit("Animation"), F.lit("Documentary")), (F.col("id") % 3 + 1).cast("int"))
    return shows(spark, d).select("id", buckets.form_of(kinds).alias("form"), buckets.truthy(F.col("id") % 4).alias("kept"), filters.in_format(kinds, "Scripted").alias("scripted"))


def study_filter(spark, d):
    s = shows(spark, d).withColumn("type", F.when(F.col("id") % 3 == 0, "Scripted").otherwise("Reality")).withColumn("premiered", F.when(F.col("id") % 9 > 0, F.concat(F.col("year").cast("string"), F.lit("-01-01"))))
    return s.where(filters.study("2000-01-01")).select("id")


def rating_matches(spark, d):
    s = shows(spark, d)
    other = s.select((F.col("id") + 1).alias("id"), F.upper(F.translate("name", "e", "é")).alias("other"), F.col("year").alias("first"), F.when(F.col("id") % 3 > 0, F.col("year") + 5).alias("last"))
    return s.join(other, "id").where(filters.plausible_match(text.fold_name("name"), text.fold_name("other"), F.col("year"), F.col("first"), F.col("last"))).select("id")


def clickstream_months(spark, d):
    """Click counts between known pages, from a tab-separated file with malformed counts."""
    folder = tables.shared_folder(spark)
    e = table(spark, d, "events").select(
        F.concat(F.lit("Item_"), F.get_json_object("props", "$.k")).alias("prev"), F.concat(F.lit("Item_"), F.col("event_id").cast("string")).alias("curr"), F.when(F.col("event_id") % 3 == 0, "external").otherwise("link").alias("type"),
        F.when(F.col("event_id") % 13 == 0, "x").otherwise((F.col("event_id") % 50).cast("string")).alias("n"),
    )
    e.write.option("sep", "\t").option("quote", "").csv(folder)
    titles = table(spark, d, "part").select(F.concat(F.lit("Item_"), F.col("p_partkey").cast("string")).alias("title"), F.col("p_partkey").alias("id"))
    return tables.month_pairs(tables.clickstream(spark, folder), titles, "2024-01")


def month_stream(spark, d):
    """Counts by month of a stream of clicks, each batch a folder of its own."""
    source, target, checkpoint = (tables.shared_folder(spark) for _ in range(3))
    li = table(spark, d, "lineitem")
    li.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_partkey").alias("prev"), F.col("l_suppkey").alias("curr"), F.col("l_linenumber").cast("long").alias("n")).write.parquet(source)
    clicks = spark.readStream.schema("month string, prev long, curr long, n long").parquet(source)
    streams.upsert_month_counts(clicks, target, checkpoint).awaitTermination()
    return streams.month_counts(spark, target)


def alias_file(spark, d):
    number = F.regexp_extract("p_brand", r"#(\d+)$", 1)
    names = table(spark, d, "part").groupBy(number.alias("id")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "p_type", "p_name"))).alias("names"))
    body = names.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.collect_list(F.struct("id", "names"))).alias("aliases"))).alias("body"))  # one row a brand
    return tables.aliases(spark, landed(body.withColumn("page", F.lit(0)), "page", "body"), most=5).select("id", F.array_join("names", ",").alias("names"))


def facts_scan(spark, d):
    """Facts of landed query results."""
    url = lambda kind, c: F.struct(F.concat(F.lit(f"http://facts.example/entity/{kind}"), c.cast("string")).alias("value"))
    c = table(spark, d, "customer")
    cell = F.struct(url("Q", F.col("c_custkey")).alias("item"), url("P", F.col("c_custkey") % 4).alias("prop"), url("Q", F.col("c_nationkey")).alias("value"))
    pages = c.groupBy(F.expr("c_custkey div 500").alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(cell).alias("bindings")).alias("results"))).alias("body"))
    triples = tables.sparql_rows(spark, landed(pages, "page", "body"))
    return tables.facts(triples, {"P0": ("genre", 1.0), "P1": ("maker", 0.5), "P2": ("genre", 0.8)})


def film_scan(spark, d):
    o = table(spark, d, "orders")
    films = o.select(F.col("o_custkey").alias("qid"), F.when(F.col("o_orderstatus") == "F", "series").otherwise("film").alias("kind"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").cast("long").alias("year"), (F.col("o_orderkey") % 40).alias("links"), (F.col("o_orderkey") % 2 == 0).alias("animated"))
    return tables.found_films(films, 5).select("qid", "kind", "title", "year", "animated")


def provider_index(spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.when(F.col("c_custkey") % 11 == 0, "?").otherwise(F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 7 > 0, (F.col("c_custkey") % 300 - 50).cast("string")).alias("weight"), F.concat(F.lit("tt"), F.repeat(F.lit("1"), (F.col("c_custkey") % 13).cast("int"))).alias("imdb"), F.when(F.col("c_custkey") % 2 == 0, "12").otherwise("x").alias("tvdb"))
    return tables.provider_index(raw)


def updates(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") - 5).cast("string").alias("id"), F.when(F.col("event_id") % 9 == 0, "never").otherwise((F.col("event_id") * 100).cast("string")).alias("updated"))
    return tables.updates_since(e, 40_000).select("id", "updated", tables.update_window(F.col("updated")).alias("window"))


def art_track(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    number = F.col("id") * 37
    bucket = F.when(F.col("id") % 6 == 0, F.lit(1)).otherwise(F.floor(number / 2500))
    images = p.where("id % 5 > 0").select("id", F.concat(F.lit("https://art.example/"), bucket.cast("string"), F.lit("/"), number.cast("string"), F.lit(".jpg")).alias("url"))
    return tables.art_track(p, images, "id", "url")


def vocabularies(spark, d):
    return tables.vocabularies(table(spark, d, "part"), ["p_brand", "p_type"]).select("name", F.array_join("values", ",").alias("values"))


def trimmed_payloads(spark, d):
    """Provider payloads cut to what is used; every seventh does not parse."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.expr("o_orderkey % 12").alias("score"))
    kind = lambda k: F.element_at(F.array(*(F.lit(x) for x in ("buy", "flatrate", "rent", "stolen"))), (F.col("o_orderkey") % 4 + 1).cast("int")) if k else F.lit("free")
    offers = F.array(F.struct((F.col("o_orderkey") % 9).alias("id"), kind(1).alias("kind"), F.lit(2).alias("priority")), F.struct(F.lit(50).cast("long").alias("id"), kind(0).alias("kind"), F.lit(1).alias("priority")))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), "score", offers.alias("providers"), F.array(F.struct(F.lit("US").alias("region"), F.lit("R").alias("rating")), F.struct(F.lit("GB").alias("region"), (F.col("o_orderkey") % 19).cast("string").alias("rating"))).alias("ratings")))
    payloads = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "{broken").otherwise(body).alias("json"))
    return tables.trimmed(payloads, "o_orderkey", "json", "GB").select("o_orderkey", "name", "score", "rating", F.array_join(F.transform("providers", lambda x: x.cast("string")), ",").alias("providers"))


def published_version(spark, d):
    """The last version that passed its checks stays current."""
    root, part = tables.shared_folder(spark), table(spark, d, "part").select("p_partkey", "p_name")
    tables.publish(part, root, "catalogue", [checks.duplicates(part, ["p_partkey"])])
    twice = part.union(part)
    try:
        tables.publish(twice, root, "catalogue", [checks.duplicates(twice, ["p_partkey"])])
    except ValueError:
        pass
    return tables.current(spark, root, "catalogue")


def pruned_versions(spark, d):
    """Of five versions the newest two stay, and the current one."""
    root, part = tables.shared_folder(spark), table(spark, d, "part").select("p_partkey", "p_size")
    for k in range(5):
        version = tables.publish(part.where(F.col("p_size") % 5 == k), root, "sizes")
    tables.prune(spark, root, "sizes", 2)
    kept = spark.read.parquet(f"{root}/sizes/versions/*").withColumn("current", F.contains(F.col("_metadata.file_path"), F.lit(version)))
    return kept.select("p_partkey", "current")


def matrix_shares(spark, d):
    """How much of a part's and of a supplier's lines each pair has, from the two copies of their matrix."""
    folder = tables.shared_folder(spark)
    names = [f"m{folder[-8:]}_{k}" for k in ("row", "col")]
    cells = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.count("*").alias("n"))
    tables.write_matrix(cells, *names, buckets=16, folder=folder)
    by_row, by_col = tables.read_matrix(spark, *names)
    of_row, of_col = matrix_share(by_row, "row"), matrix_share(by_col, "col")
    return of_row.withColumnRenamed("share", "of_row").join(of_col.select("row", "col", F.col("share").alias("of_col")), ["row", "col"])


def matrix_share(cells, key):
    """Each cell's part of its row's (or column's) sum: no shuffle where the cells are bucketed by the key."""
    return cells.join(cells.groupBy(key).agg(F.sum("n").alias("all")), key).select("row", "col", F.round(F.col("n") / F.col("all"), 9).alias("share"))


def entity_labels(spark, d):
    """Labels of customers in the languages of their nation's number."""
    c = table(spark, d, "customer")
    names = F.array(*(F.struct(F.lit(lang).alias("lang"), text_.alias("text")) for lang, text_ in (
        ("en", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), "c_name", F.lit("  Ltd ")))), ("mul", F.when(F.col("c_custkey") % 4 == 1, F.col("c_mktsegment"))),
        ("fr", F.lower("c_mktsegment")), ("de", F.lower("c_mktsegment")), ("it", F.col("c_name")), ("es", F.when(F.col("c_custkey") % 4 == 3, F.col("c_name"))), ("pl", F.lit(" ")),
    )))
    return tables.entity_labels(c.select(F.col("c_custkey").alias("item"), F.explode(names).alias("n")).select("item", "n.*"))


def belongs_to(spark, d):
    """What parts belong to by way of suppliers, nations and regions, each statement with its weight."""
    li, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    facts = li.select(name("p", "l_partkey").alias("item"), name("s", "l_suppkey").alias("value"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.8).alias("multiplier"))
    triples = s.select(name("s", "s_suppkey").alias("item"), F.when(F.col("s_suppkey") % 2 == 0, "P8345").otherwise("P179").alias("prop"), name("n", "s_nationkey").alias("value"))
    triples = triples.union(n.select(name("n", "n_nationkey"), F.lit("P1434"), name("r", "n_regionkey"))).union(n.select(name("n", "n_nationkey"), F.lit("P31"), F.lit("nation")))
    out = tables.typed_hops(facts, triples, {"P179": 0.5, "P8345": 0.4, "P1434": 0.25})
    return out.select("item", "value", F.round("multiplier", 6).alias("multiplier"), F.col("hops").cast("long").alias("hops"))


def report_files(spark, d):
    """A report of one sorted CSV file, read back."""
    folder = tables.shared_folder(spark)
    tables.write_report(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size")), folder, ["p_brand"])
    return spark.read.option("header", True).schema("p_brand string, n long, size long").csv(folder)


def facet_files(spark, d):
    """Facet tables, read back: tokens with their document frequency."""
    from .model import facets

    folder = tables.shared_folder(spark)
    tables.write_facets(facets(spark, d), table(spark, d, "part").select("p_partkey", "p_name"), folder)
    values, tokens = spark.read.parquet(f"{folder}/facet_values"), spark.read.parquet(f"{folder}/facet_tokens")
    return tokens.join(values.groupBy("family", "token").agg(F.count("*").alias("rows")), ["family", "token"]).select("family", "token", "df", "rows")


def month_checks(spark, d):
    """Months missing from what is held, and months that a recount would lose."""
    li = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct()
    held, new = li.where("substr(month, 6) <> '03' and month not like '%12'"), li.where("substr(month, 6) <> '05'")
    missing = checks.missing_months(li, held, 14).select(F.lit("missing").alias("kind"), "month")
    return missing.union(checks.recount_loses(new, held, li).select(F.lit("lost").alias("kind"), "month"))


def carried_versions(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("valid"))
    return checks.latest_valid(v, "component", "version", "valid")


def share_guard(spark, d):
    o = table(spark, d, "orders")
    y = o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return y.join(y.select((F.col("year") + 1).alias("year"), F.col("n").alias("before")), "year", "left").select("year", checks.min_share(F.col("before"), F.col("n"), 0.9).alias("kept"))


def persona_checks(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    listed = p.select((F.col("id") * 2).alias("id"), F.when(F.col("id") % 10 == 0, F.lit("renamed")).otherwise(F.lit(None)).alias("other")).join(p, "id", "left").select("id", F.coalesce("other", "p_name").alias("p_name"))
    return checks.mismatches(listed, p, "id", ["p_name"]).select("id")


def held_ranks(spark, d):
    """Rank of each left-out show among a list's scores."""
    r = ratings(spark, d)
    held = r.where("weight >= 0.7").select("user_id", F.col("id").alias("fold"))
    scored = held.join(r.select("user_id", "id"), "user_id").where("(fold + id) % 3 > 0").withColumn("score", ((F.col("id") * 31 + F.col("fold")) % 97).cast("double"))
    return evaluate.held_ranks(scored, held).withColumn("rank", F.col("rank").cast("long"))


def first_items_overlap(spark, d):
    """How much the first twelve shows of two lists have in common."""
    lists = ratings(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("items"))
    out = sets.overlap(lists, "user_id", "items", lists.select("user_id"))
    return out.withColumn("overlap", F.round("overlap", 6))


def numbered_runs(spark, d):
    e = table(spark, d, "orders")
    gap = F.expr("datediff(o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) > 90")
    return sequences.islands(e.withColumn("gap", gap), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("gap")).select("o_orderkey", F.col("run").cast("long").alias("run"))


def daily_slots(spark, d):
    return table(spark, d, "events").select("event_id", dates.next_slot(F.col("ts"), 4).alias("slot"), F.round(dates.decayed(F.col("event_id") % 30), 9).alias("decay"))


def dimension_suggestions(spark, d):
    k = F.col("id")
    out = client.suggestions(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 / 10)
    return shows(spark, d).select("id", F.round(out, 6).alias("worth"))


def birthplaces(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    town = F.when(F.col("c_custkey") % 4 > 0, F.concat_ws(", ", F.lit("Town"), F.when(F.col("c_custkey") % 3 == 0, F.col("n_name"))))
    return j.select("c_custkey", rows.birthplace(town, F.col("n_name"), F.col("r_name")).alias("text"))


def recent_matches(spark, d):
    e = table(spark, d, "part").select("p_partkey", F.initcap("p_name").alias("text"))
    return search.recent_matches(e, "text", F.lit(" Re")).select("p_partkey")


def version_verdict(spark, d):
    """A sound track, one that lacks shows, and one that has some twice."""
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    tracks = {"popularity": ids, "art": ids.where("id % 50 > 0"), "facets": ids.union(ids.where("id < 3"))}
    return checks.version_verdict(ids, tracks, "2024-05-06", "2024-05-06T03:00:00Z", previous=ids.count() + ids.count() // 5)


def show_shapes(spark, d):
    s = shows(spark, d).withColumn("image", F.col("id") * 37 % 9000).withColumn("known", F.col("popularity")).withColumn("channel", F.col("network"))
    scores = s.select("id", (F.col("id") % 99 + 1).cast("int").alias("match"))
    m = rows.marked(s, scores, newest=F.col("year") >= 2020)
    return rows.shaped(rows.shaped(m, "tile").join(rows.shaped(m, "card").select("id", "channel", "known"), "id"), "tile").select("id", "name", F.col("year").cast("long").alias("year"), "poster", "badge", F.col("match").cast("long").alias("match"), F.col("place").cast("long").alias("place"))


def synthetic_viewers(spark, d):
    """Lists of sixty for every user, from what they rated."""
    r = ratings(spark, d)
    core = r.where("pos < 20").select(F.col("user_id").alias("viewer"), "id", "weight")
    held = r.where("pos between 20 and 24 and weight >= 0.7").select(F.col("user_id").alias("viewer"), "id")
    s = shows(spark, d)
    users = core.select("viewer").distinct()
    near = s.select("id", (F.col("id") % 10).alias("k"))
    pool = lambda name, rows_: rows_.select("viewer", F.lit(name).alias("source"), "id", F.lit(1.0).alias("strength"))
    related = pool("related", core.where("weight > 0").select("viewer", (F.col("id") % 10).alias("k")).distinct().join(near, "k"))
    contrast = pool("contrast", core.where("weight < 0").select("viewer", (F.col("id") % 10).alias("k")).distinct().join(near, "k"))
    best = s.orderBy(F.desc("popularity"), "id").limit(200).select("id", F.lit(1).alias("one"))  # a fixed number of shows for each user
    main = pool("mainstream", users.withColumn("one", F.lit(1)).join(F.broadcast(best), "one"))
    return evaluate.synthetic_viewers(core, held, related.union(contrast).union(main), s.select("id", F.col("popularity").alias("known")), 60, "bench").select("viewer", "id", "weight", "source", F.col("place").cast("long").alias("place"))


_RAW = "FROM part"
_ENC = " + ".join(f"CASE WHEN list_contains(string_split(p_name, ' '), '{w}') THEN {1 << k} ELSE 0 END" for k, w in enumerate(GENRES))
QUERIES = [
    Query("landed_show_records", show_records, f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 17 > 0 THEN 1950 + p_partkey % 75 END::BIGINT AS year, CASE WHEN p_partkey % 4 > 0 THEN 45 ELSE nullif(p_size, 0) END::BIGINT AS runtime, round(5 + p_partkey % 50 / 10, 6)::DOUBLE AS rating,
        CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 3 > 0 OR p_partkey % 5 = 0) THEN 'GB' END AS country, CASE WHEN p_partkey % 5 = 0 THEN 'Web' WHEN p_partkey % 3 > 0 THEN p_brand END AS channel,
        trim('The ' || p_name || ' & the ' || p_name || 's: war in space, ' || repeat('word ', p_partkey % 20)) AS summary, (8 + p_partkey % 20)::BIGINT AS summary_words, ({_ENC})::BIGINT AS genre_bits, 3::BIGINT AS theme_bits,
        p_partkey % 17 > 0 AND 1950 + p_partkey % 75 <= 2010 AS recommendable, CASE WHEN 8 + p_partkey % 20 >= 15 THEN 'plot and genres' ELSE 'genres only' END AS coverage {_RAW}"""),
    Query("landed_channels", show_channels, "SELECT p_partkey AS id, 'network:' || p_size AS channel, p_brand AS name FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'web:' || p_partkey % 7, 'Web' FROM part WHERE p_partkey % 5 = 0"),
    Query("landed_external_ids", external_ids, "SELECT p_partkey AS id, 'tt' || lpad(p_partkey::VARCHAR, 7, '0') AS imdb FROM part WHERE p_partkey % 7 > 0"),
    Query("show_forms", show_forms, "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'scripted' WHEN 1 THEN 'animation' ELSE 'factual' END AS form, nullif(p_partkey % 4, 0) AS kept, p_partkey % 3 = 0 AS scripted FROM part"),
    Query("study_filter", study_filter, f"WITH {SHOWS_SQL} SELECT id FROM shows WHERE language = 'English' AND id % 3 = 0 AND summary_words >= 15 AND id % 9 > 0 AND year <= 2000"),
    Query("rating_matches", rating_matches, f"WITH {SHOWS_SQL} SELECT s.id FROM shows s JOIN shows o ON o.id + 1 = s.id WHERE s.name = strip_accents(lower(upper(replace(o.name, 'e', 'é')))) AND s.year BETWEEN o.year - 1 AND CASE WHEN o.id % 3 > 0 THEN o.year + 5 ELSE s.year END + 1"),
    Query("clickstream_months", clickstream_months, "WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS p, event_id AS c, CASE WHEN event_id % 13 > 0 THEN event_id % 50 END AS n FROM events) SELECT '2024-01' AS month, least(p, c) AS a, greatest(p, c) AS b, coalesce(sum(n), 0)::BIGINT AS n FROM e WHERE p <> c AND p IN (SELECT p_partkey FROM part) AND c IN (SELECT p_partkey FROM part) GROUP BY ALL"),
    Query("month_stream", month_stream, "SELECT strftime(l_shipdate, '%Y-%m') AS month, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL"),
    Query("alias_file", alias_file, "WITH n AS (SELECT DISTINCT regexp_extract(p_brand, '#(\\d+)$', 1)::BIGINT AS id, p_type || ' ' || p_name AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS k FROM n) SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM k WHERE k <= 5 GROUP BY id"),
    Query("facts_scan", facts_scan, "SELECT 'Q' || c_custkey AS item, CASE WHEN c_custkey % 4 = 1 THEN 'maker' ELSE 'genre' END AS family, 'Q' || c_nationkey AS value, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.8 END::DOUBLE AS multiplier FROM customer WHERE c_custkey % 4 < 3"),
    Query("film_scan", film_scan, "WITH f AS (SELECT o_custkey AS qid, CASE WHEN o_orderstatus = 'F' THEN 'series' ELSE 'film' END AS kind, o_orderpriority AS title, year(o_orderdate)::BIGINT AS year, o_orderkey % 2 = 0 AS animated FROM orders WHERE o_orderkey % 40 >= 5), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kind <> 'series', title) AS k, min(year) OVER (PARTITION BY qid) AS first, max(animated) OVER (PARTITION BY qid) AS drawn FROM f) SELECT qid, kind, title, first AS year, drawn AS animated FROM k WHERE k = 1"),
    Query("provider_index", provider_index, "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN greatest(0, least(100, c_custkey % 300 - 50))::DOUBLE END AS weight, CASE WHEN c_custkey % 13 BETWEEN 5 AND 10 THEN 'tt' || repeat('1', c_custkey % 13) END AS imdb, CASE WHEN c_custkey % 2 = 0 THEN 12 END::BIGINT AS tvdb FROM customer WHERE c_custkey % 11 > 0"),
    Query("updates_since", updates, "SELECT event_id - 5 AS id, event_id * 100 AS updated, CASE WHEN event_id * 100 < 86400 THEN 'day' WHEN event_id * 100 < 604800 THEN 'week' ELSE 'month' END AS window FROM events WHERE event_id % 9 > 0 AND event_id > 5 AND event_id * 100 > 40000"),
    Query("art_track", art_track, "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 AND (p_partkey % 6 > 0 OR p_partkey * 37 // 2500 = 1) THEN p_partkey * 37 ELSE 0 END AS image FROM part"),
    Query("vocabularies", vocabularies, "SELECT 'p_brand' AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS values FROM part UNION ALL SELECT 'p_type', string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part"),
    Query("trimmed_payloads", trimmed_payloads, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 12 <= 10 THEN (o_orderkey % 12)::DOUBLE END AS score, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 19)::VARCHAR END AS rating, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 9 = 0 OR o_orderkey % 4 = 3 THEN '50' WHEN o_orderkey % 4 = 1 THEN o_orderkey % 9 || ',50' ELSE '50,' || o_orderkey % 9 END AS providers FROM orders"),
    Query("published_version", published_version, "SELECT p_partkey, p_name FROM part"),
    Query("pruned_versions", pruned_versions, "SELECT p_partkey, p_size % 5 = 4 AS current FROM part WHERE p_size % 5 >= 3"),
    Query("matrix_shares", matrix_shares, 'WITH m AS (SELECT l_partkey AS "row", l_suppkey AS col, count(*) AS n FROM lineitem GROUP BY ALL) SELECT "row", col, round(n / sum(n) OVER (PARTITION BY "row"), 9) AS of_row, round(n / sum(n) OVER (PARTITION BY col), 9) AS of_col FROM m'),
    Query("entity_labels", entity_labels, "SELECT c_custkey AS item, CASE c_custkey % 4 WHEN 0 THEN c_name || ' Ltd' WHEN 1 THEN c_mktsegment WHEN 2 THEN lower(c_mktsegment) ELSE lower(c_mktsegment) END AS label FROM customer"),
    Query("belongs_to", belongs_to, """WITH f AS (SELECT 'p' || l_partkey AS item, l_suppkey AS s, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.8 END)::DOUBLE AS m FROM lineitem GROUP BY ALL),
        a AS (SELECT item, 's' || s AS value, m, 0 AS hops FROM f UNION ALL SELECT item, 'n' || s_nationkey, max(m * CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 0.5 END), 1 FROM f JOIN supplier ON s_suppkey = s GROUP BY ALL
        UNION ALL SELECT item, 'r' || n_regionkey, max(m * CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 0.5 END * 0.25), 2 FROM f JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
        SELECT item, value, round(m, 6) AS multiplier, hops::BIGINT AS hops FROM a"""),
    Query("report_files", report_files, "SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY p_brand"),
    Query("facet_files", facet_files, "WITH t AS (SELECT p_partkey AS id, 'brand' AS family, p_brand AS token FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'word', unnest(string_split(p_name, ' ')) FROM part), c AS (SELECT family, token, count(DISTINCT id) AS df FROM t GROUP BY ALL) SELECT family, token, df, df AS rows FROM c WHERE df >= 2 AND df < (SELECT count(*) FROM part)"),
    Query("month_checks", month_checks, "WITH m AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem), h AS (SELECT month FROM m WHERE substr(month, 6) NOT IN ('03', '12')) SELECT 'missing' AS kind, month FROM (SELECT month FROM m ORDER BY month DESC LIMIT 14) WHERE month NOT IN (SELECT month FROM h) UNION ALL SELECT 'lost', month FROM h WHERE substr(month, 6) = '05'"),
    Query("carried_versions", carried_versions, "SELECT o_custkey AS component, max(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    Query("share_guard", share_guard, "WITH y AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1) SELECT a.year, a.n >= 0.9 * coalesce(b.n, 0) AS kept FROM y a LEFT JOIN y b ON b.year + 1 = a.year"),
    Query("persona_checks", persona_checks, "SELECT 2 * p_partkey AS id FROM part WHERE 2 * p_partkey NOT IN (SELECT p_partkey FROM part) OR p_partkey % 10 = 0"),
    Query("held_ranks", held_ranks, f"WITH {RATINGS_SQL}, h AS (SELECT user_id, id AS fold FROM ratings WHERE weight >= 0.7), s AS (SELECT h.user_id, fold, r.id, row_number() OVER (PARTITION BY h.user_id, fold ORDER BY (r.id * 31 + fold) % 97 DESC, r.id) AS rank FROM h JOIN ratings r ON r.user_id = h.user_id WHERE (fold + r.id) % 3 > 0) SELECT h.user_id, h.fold, s.rank FROM h LEFT JOIN s ON s.user_id = h.user_id AND s.fold = h.fold AND s.id = h.fold"),
    Query("first_items_overlap", first_items_overlap, f"WITH {RATINGS_SQL}, t AS (SELECT user_id, id, count(*) OVER (PARTITION BY user_id) AS n FROM ratings WHERE pos < 12) SELECT x.user_id AS a, y.user_id AS b, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) AS overlap FROM t x JOIN t y ON x.id = y.id AND x.user_id <> y.user_id GROUP BY x.user_id, y.user_id"),
    Query("numbered_runs", numbered_runs, "WITH g AS (SELECT o_orderkey, o_custkey, o_orderdate, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) > 90 AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, (1 + sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::BIGINT AS run FROM g"),
    Query("daily_slots", daily_slots, "SELECT event_id, date_trunc('day', ts - INTERVAL 4 HOUR) + INTERVAL 28 HOUR AS slot, round(pow(0.5, event_id % 30 / 7.0), 9) AS decay FROM events"),
    Query("dimension_suggestions", dimension_suggestions, "SELECT p_partkey AS id, round(CASE WHEN p_partkey % 2 = 0 THEN 3.0 WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 1.0 ELSE 0.0 END + p_partkey % 7 / 10, 6)::DOUBLE AS worth FROM part"),
    Query("birthplaces", birthplaces, "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE 'Town, ' || n_name END || CASE WHEN contains(lower(n_name), lower(r_name)) THEN '' ELSE ', ' || r_name END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    Query("version_verdict", version_verdict, "SELECT * FROM (VALUES ('ids', true), ('popularity', true), ('art', false), ('facets', false), ('date', true), ('size', false)) v(\"check\", ok)"),
    Query("show_shapes", show_shapes, f"WITH {SHOWS_SQL}, b AS (SELECT id, row_number() OVER (ORDER BY popularity DESC, id) AS k FROM shows) SELECT id, name, year::BIGINT AS year, CASE WHEN id * 37 % 9000 > 0 THEN 'https://images.example/medium_portrait/' || id * 37 % 9000 // 2500 || '/' || id * 37 % 9000 || '.jpg' END AS poster, CASE WHEN k <= 10 THEN 'top10' WHEN year >= 2020 THEN 'new' END AS badge, id % 99 + 1 AS match, CASE WHEN k <= 10 THEN k END AS place FROM shows JOIN b USING (id)"),
    Query("synthetic_viewers", synthetic_viewers),
    Query("recent_matches", recent_matches, "SELECT p_partkey FROM part WHERE starts_with(p_name, 're') OR contains(p_name, ' re')"),
]
