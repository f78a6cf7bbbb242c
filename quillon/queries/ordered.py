"""Ordered rows: runs, sessions, decay, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import packed
from ..operators import aggregates, joins, sequences, sets
from ..plans.stand_ins import SHOWS_SQL, item_events, shows
from ..sources.tables import table
from ..streaming import queues, streams
from . import Query

TODAY = "2024-01-25"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as episodes: four turns a season, the length of the text as rating, unknown for an empty text."""
    return table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 4).alias("season"), F.col("turn").alias("number"), F.when(F.length("text") > 0, F.length("text").cast("double")).alias("rating"))


def moving_average(spark, d):
    out = sequences.moving_average(turns(spark, d), ["conv_id"], "season", "number", "rating")
    return out.select("conv_id", "season", "number", F.col("run").cast("long").alias("run"), F.round("smooth", 6).alias("smooth"))


def episode_matrix(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.length("text").cast("long").alias("n"))
    out = sequences.grid(t, ["conv_id"], "turn", "n", 4)
    return out.select("conv_id", *(F.col(str(k)).alias(f"t{k}") for k in range(1, 5)))


def season_averages(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("season"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("rating"))
    out = aggregates.season_averages(o, "o_custkey", "season", "rating")
    return out.select("o_custkey", "season", F.col("overall").cast("long").alias("overall"), F.round("average", 6).alias("average"), "rated")


def episode_summary(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("season"), F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice")).alias("minutes"))
    return aggregates.episode_summary(o, "o_custkey", F.col("o_orderstatus") == "F", "season", "minutes")


def watched_through(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "N").alias("watched"), "l_partkey", "l_returnflag")
    out = sequences.watched_through(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"], "watched", "l_linenumber")
    return out.select("l_orderkey", F.col("through").cast("long").alias("through"), "watched", F.col("next").cast("long").alias("next"), "caught_up")


def episode_neighbours(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    out = sequences.neighbours(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey", F.col("l_returnflag") != "N")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "previous", "next")


def session_30min(spark, d):
    out = sequences.sessions(table(spark, d, "events"), "user_id", "ts")
    return out.select("user_id", "start", "last", "events")


def visit_numbers(spark, d):
    out = sequences.visits(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts")
    return out.groupBy("user_id", F.col("visit").cast("long").alias("visit")).agg(F.count("*").alias("events"), F.min("day").alias("day"))


def decayed_impressions(spark, d):
    days = item_events(spark, d).where("event_type = 'view'").select("user_id", "item", F.to_date("ts").alias("day"))
    return sequences.decayed_counts(days, ["user_id", "item"], "day", F.lit(TODAY).cast("date")).withColumn("seen", F.round("seen", 6))


def tired_rows(spark, d):
    days = item_events(spark, d).select("user_id", "event_type", F.to_date("ts").alias("day"), (F.col("value") > 95).alias("engaged"))
    return sequences.tired(days, ["user_id", "event_type"], "day", "engaged", F.lit(TODAY).cast("date"))


def latest_wins(spark, d):
    return sequences.latest(item_events(spark, d).select("user_id", "item", "ts", "event_id", "event_type", "value"), ["user_id", "item"], ["ts", "event_id"]).select("user_id", "item", "event_id", "event_type", "value")


def newest_k(spark, d):
    return sequences.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3)


def mutation_log(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("operation_id"), F.col("event_id").alias("revision"), "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("intent"), F.when(F.col("value") > 50, F.col("value")).alias("progress"), (F.col("event_type") == "error").alias("deleted"))
    replayed = e.union(e.where("deleted").withColumn("revision", F.col("revision") + 1_000_000))  # sent again: must not count
    return sequences.fold_mutations(replayed, ["user_id"], ["intent", "progress"]).select("user_id", "intent", "progress", "revision")


def generations(spark, d):
    return sequences.generations(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("generation").cast("long").alias("generation"), "generations")


def as_of(spark, d):
    o = table(spark, d, "orders")
    left = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    right = o.where("o_orderstatus = 'O'").groupBy("o_custkey", F.col("o_orderdate").alias("when")).agg(F.max("o_totalprice").alias("price"))
    return joins.as_of(left, right, ["o_custkey"], "at", "when", ["price"]).select("o_orderkey", "price")


def merged_ratings(spark, d):
    o = table(spark, d, "orders")
    main = o.select("o_orderkey", F.to_date("o_orderdate").alias("airdate"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("rating"))
    other = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.to_date("l_shipdate")).alias("airdate"), F.sum("l_quantity").alias("rating"), F.sum("l_quantity").cast("long").alias("votes"))
    return joins.merged_ratings(main, other, ["o_orderkey"], votes=60, days=30).select("o_orderkey", "merged", "source")


def resolved_ids(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("show"), F.concat(F.lit("t"), F.col("c_custkey") % 400).alias("imdb"))
    statements = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("show"))
    external = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("imdb"))
    return joins.resolve_ids(own, statements, external)


def people_match(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") + 1).alias("linked"), F.col("c_mktsegment").alias("name"), F.floor("c_acctbal").cast("string").alias("birth"))
    right = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_mktsegment").alias("name"), F.floor("c_acctbal").cast("string").alias("birth"))
    return joins.match_people(left, right)


def first_source(spark, d):
    o = table(spark, d, "orders")
    part = lambda s: o.where(f"o_orderstatus = '{s}'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return joins.first_of([part("P"), part("F"), part("O")], ["o_custkey"]).select("o_custkey", "o_orderkey", F.col("source_rank").cast("long").alias("source_rank"))


def nightly_plan(spark, d):
    s = shows(spark, d)
    phases = [(F.col("rating").isNull(), [("popularity", False)]), (F.col("popularity") >= 90, [("popularity", False)]), (F.col("status") == "Running", [("year", True)])]
    return sets.fetch_plan(s.select("id", "rating", "popularity", "status", "year"), "id", phases, 300).select("id", F.col("phase").cast("long").alias("phase"))


def cold_start_rows(spark, d):
    rows = [("top", F.col("recommendable"), [F.desc("popularity")]), ("classics", F.col("year") < 1980, [F.desc_nulls_last("rating")]), ("new", F.col("year") >= 2015, [F.desc("year")])]
    return sets.cold_rows(shows(spark, d), rows, "id", 20).select("id", F.col("place").cast("long").alias("place"), "row", F.col("row_order").cast("long").alias("row_order"))


def fingerprints(spark, d):
    return table(spark, d, "part").select("p_partkey", packed.fingerprint(F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("digest"))


# ------------------------------------------------------------------ streams


def _stream(spark, d):
    batch = table(spark, d, "events")
    return streams.event_stream(spark, d, batch.schema, pattern="events.parquet") if _is_file(spark, d) else streams.event_stream(spark, f"{d}/events.parquet", batch.schema)


def _is_file(spark, d) -> bool:
    """Whether the table is one file; Spark's file stream lists folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def stream_impressions(spark, d):
    e = _stream(spark, d).withColumn("item", F.get_json_object("props", "$.k").cast("long"))
    return streams.drain(streams.daily_impressions(e, "item").select("user_id", "item", "day"))


def stream_latest(spark, d):
    out = streams.drain(streams.latest_rows(_stream(spark, d), "user_id", "event_type"), "complete")
    return out.select("user_id", "event_type")


def stream_sessions(spark, d):
    """Closed visits: those the watermark has passed."""
    out = streams.drain(streams.visit_sessions(_stream(spark, d)))
    return out.select("user_id", F.col("session_window.start").alias("start"), "events")


def stream_metrics(spark, d):
    out = streams.drain(streams.tumbling_counts(_stream(spark, d), ["event_type"], width="1 day"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def stream_demand(spark, d):
    requests = _stream(spark, d).select(F.col("user_id").alias("id"), F.col("event_type").alias("source"), (F.col("value") > 90).cast("int").alias("urgent"), F.unix_micros("ts").cast("double").alias("requested"))
    last = streams.drain(streams.demand_queue(requests), "update")
    return last.groupBy("id", "source").agg(F.max("urgent").cast("long").alias("urgent"), F.min("requested").alias("requested"), F.max("asked").alias("asked"))


def stream_budget(spark, d):
    requests = _stream(spark, d).select(F.col("user_id").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("request"))
    return streams.drain(streams.token_bucket(requests, rate=1 / 3600, burst=3.0))


def stream_admission(spark, d):
    requests = _stream(spark, d).select(F.col("user_id").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("request"))
    return streams.drain(streams.host_admission(requests, gap=3600.0)).withColumn("start", F.round("start", 3))


def stream_high_water(spark, d):
    updates = _stream(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("updated"))
    out = streams.drain(streams.high_water(updates))
    return out.groupBy("id").agg(F.max("updated").alias("updated"))


def _requests(spark, d):
    """Demands, leases and answers out of events: two queues by user, entries by item."""
    item = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_id") % 5 == 3, "next").when(F.col("event_id") % 5 == 4, "done").otherwise("demand")
    retry = F.when((kind == "done") & (F.col("event_id") % 2 == 0), F.lit(7_200_000_000))
    return _stream(spark, d).select("ts", F.col("event_id").alias("number"), F.when(F.col("user_id") % 2 == 0, "tv").otherwise("film").alias("source"), kind.alias("kind"), item.alias("id"), (F.col("value") > 60).cast("int").alias("urgent"), retry.alias("retry"))


def stream_queue(spark, d):
    """What becomes of each request of two bounded queues."""
    out = streams.drain(queues.demand_queue(_requests(spark, d), most=24, shards=2), state_store=queues.ROCKS)
    return out.select("source", F.col("shard").cast("long").alias("shard"), "id", "said", "at")


def stream_poll(spark, d):
    """Items asked for, newest first, at least an hour apart in each of two shards."""
    updates = _stream(spark, d).select("ts", F.col("event_id").alias("number"), F.get_json_object("props", "$.k").cast("long").alias("id"), F.col("event_id").alias("updated"))
    return streams.drain(queues.updates_poll(updates, newest=20, reach=70, most=30, gap=3_600_000, shards=2), state_store=queues.ROCKS).withColumn("shard", F.col("shard").cast("long"))


def stream_expiry(spark, d):
    """When users come to be held and are forgotten after six hours without an event."""
    rows = _stream(spark, d).select("ts", F.col("user_id").alias("key"))
    return streams.drain(queues.expiring(rows, EXPIRY), state_store=queues.ROCKS)


#: Microseconds after which a user without events is forgotten.
EXPIRY = 6 * 3_600_000_000

_RUNS = """WITH t AS (SELECT conv_id, turn // 4 AS season, turn AS number, length(text)::DOUBLE AS rating FROM conversations WHERE length(text) > 0),
b AS (SELECT *, CASE WHEN lag(season) OVER w <> season OR number - lag(number) OVER w <> 1 THEN 1 ELSE 0 END AS br FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY season, number)),
r AS (SELECT *, 1 + sum(br) OVER (PARTITION BY conv_id ORDER BY season, number) AS run FROM b)
SELECT conv_id, season, number, run::BIGINT AS run, round(avg(rating) OVER (PARTITION BY conv_id, run ORDER BY number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM r"""
_ISLANDS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS br FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "last", count(*) AS events FROM r GROUP BY user_id, run"""
_EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events)"

QUERIES = [
    Query("gaps_islands_moving_avg", moving_average, _RUNS),
    Query("episode_matrix_pivot", episode_matrix, "SELECT conv_id, " + ", ".join(f"max(length(text)) FILTER (turn = {k})::BIGINT AS t{k}" for k in range(1, 5)) + " FROM conversations GROUP BY conv_id"),
    Query("season_averages", season_averages, "WITH o AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS season, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS rating FROM orders) SELECT o_custkey, season, grouping(season)::BIGINT AS overall, round(avg(rating), 6) AS average, count(rating) AS rated FROM o GROUP BY GROUPING SETS ((o_custkey, season), (o_custkey))"),
    Query("episode_summary", episode_summary, "SELECT o_custkey, count(*) AS episodes, count(DISTINCT year(o_orderdate)) AS seasons, CASE WHEN count(*) FILTER (o_orderpriority = '5-LOW' OR floor(o_totalprice) <= 0) = 0 THEN sum(floor(o_totalprice))::BIGINT END AS minutes FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    Query("watched_through", watched_through, "WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS pos FROM lineitem), f AS (SELECT *, min(CASE WHEN NOT w THEN pos END) OVER (PARTITION BY l_orderkey) AS first FROM p) SELECT l_orderkey, arg_max(l_linenumber, pos) FILTER (first IS NULL OR pos < first)::BIGINT AS through, count(*) FILTER (w) AS watched, max(CASE WHEN pos = first THEN l_linenumber END)::BIGINT AS next, bool_and(w) AS caught_up FROM f GROUP BY l_orderkey"),
    Query("episode_neighbours", episode_neighbours, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, lag(l_partkey) OVER w AS previous, lead(l_partkey) OVER w AS next FROM lineitem WHERE l_returnflag <> 'N' WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)"),
    Query("session_30min", session_30min, _ISLANDS),
    Query("visit_numbers", visit_numbers, "WITH v AS (SELECT user_id, event_id, ts, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(day) OVER w <> day THEN 1 ELSE 0 END AS br FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, 1 + sum(br) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM g) SELECT user_id, visit::BIGINT AS visit, count(*) AS events, min(day) AS day FROM r GROUP BY ALL"),
    Query("decayed_impressions", decayed_impressions, f"WITH {_EV}, x AS (SELECT DISTINCT user_id, item, CAST(ts AS DATE) AS day FROM ev WHERE event_type = 'view') SELECT user_id, item, round(sum(pow(0.5, date_diff('day', day, DATE '{TODAY}') / 7.0)), 6) AS seen FROM x WHERE day < DATE '{TODAY}' GROUP BY ALL"),
    Query("tired_rows", tired_rows, f"SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '{TODAY}') BETWEEN 0 AND 13 GROUP BY ALL HAVING count(DISTINCT CAST(ts AS DATE)) >= 5 AND NOT bool_or(value > 95)"),
    Query("latest_wins_merge", latest_wins, f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS k FROM ev) SELECT user_id, item, event_id, event_type, value FROM r WHERE k = 1"),
    Query("keep_latest_k", newest_k, "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 3"),
    Query("mutation_log", mutation_log, "SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS intent, arg_max(value, event_id) FILTER (value > 50) AS progress, max(event_id) AS revision FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"),
    Query("content_generations", generations, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS generation, count(*) OVER (PARTITION BY o_custkey) AS generations FROM orders"),
    Query("as_of_join", as_of, "WITH r AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT l.o_orderkey, r.price FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') l ASOF LEFT JOIN r ON r.o_custkey = l.o_custkey AND r.o_orderdate <= l.o_orderdate"),
    Query("merged_ratings", merged_ratings, "WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS r FROM orders), o AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS b, sum(l_quantity) AS q, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY l_orderkey), j AS (SELECT o_orderkey, r, v, CASE WHEN coalesce(abs(date_diff('day', b, a)) <= 30, true) AND v > 0 THEN q END AS t FROM m LEFT JOIN o ON l_orderkey = o_orderkey) SELECT o_orderkey, CASE WHEN v >= 60 AND t IS NOT NULL THEN t ELSE coalesce(r, t) END AS merged, CASE WHEN (v >= 60 AND t IS NOT NULL) OR (r IS NULL AND t IS NOT NULL) THEN 'other' WHEN r IS NOT NULL THEN 'own' END AS source FROM j"),
    Query("id_resolution", resolved_ids, """WITH st AS (SELECT o_orderkey AS item, o_custkey AS sh FROM orders WHERE o_orderstatus = 'P'), dr AS (SELECT sh, min(item) AS item FROM st GROUP BY sh),
        fr AS (SELECT o_orderkey AS item, 't' || o_orderkey AS imdb FROM orders WHERE o_orderkey NOT IN (SELECT item FROM st)), re AS (SELECT DISTINCT c_custkey AS sh, item FROM customer JOIN fr ON imdb = 't' || (c_custkey % 400)),
        o1 AS (SELECT item, min(sh) AS sh FROM re GROUP BY item HAVING count(DISTINCT sh) = 1) SELECT sh AS "show", item, 'statement' AS via FROM dr UNION ALL SELECT sh, min(item), 'external' FROM o1 WHERE sh NOT IN (SELECT sh FROM dr) GROUP BY sh"""),
    Query("people_match", people_match, "WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 END AS linked, c_mktsegment AS n, floor(c_acctbal)::BIGINT AS b FROM customer), o AS (SELECT n, b, min(id) AS id FROM l WHERE linked IS NULL GROUP BY n, b HAVING count(*) = 1), r AS (SELECT n, b, min(id) + 1 AS id FROM l GROUP BY n, b HAVING count(*) = 1) SELECT id AS left_id, linked AS right_id, 'linked' AS via FROM l WHERE linked IS NOT NULL UNION ALL SELECT o.id, r.id, 'name' FROM o JOIN r USING (n, b) WHERE r.id NOT IN (SELECT linked FROM l WHERE linked IS NOT NULL)"),
    Query("first_source", first_source, "WITH u AS (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS source_rank, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(o_orderkey, source_rank) AS o_orderkey, min(source_rank)::BIGINT AS source_rank FROM u GROUP BY o_custkey"),
    Query("nightly_fetch_plan", nightly_plan, f"WITH {SHOWS_SQL}, p AS (SELECT *, CASE WHEN rating IS NULL THEN 0 WHEN popularity >= 90 THEN 1 WHEN status = 'Running' THEN 2 END AS phase FROM shows) SELECT id, phase::BIGINT AS phase FROM p WHERE phase IS NOT NULL ORDER BY phase, CASE WHEN phase < 2 THEN popularity END DESC, CASE WHEN phase = 2 THEN year END, id LIMIT 300"),
    Query("cold_start_rows", cold_start_rows, f"WITH {SHOWS_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY popularity DESC, id) AS place FROM shows WHERE recommendable), t AS (SELECT * FROM a WHERE place <= 20), b AS (SELECT id, row_number() OVER (ORDER BY rating DESC NULLS LAST, id) AS place FROM shows WHERE year < 1980 AND id NOT IN (SELECT id FROM t)), c AS (SELECT * FROM b WHERE place <= 20), e AS (SELECT id, row_number() OVER (ORDER BY year DESC, id) AS place FROM shows WHERE year >= 2015 AND id NOT IN (SELECT id FROM t UNION ALL SELECT id FROM c)) SELECT id, place, 'top' AS row, 0::BIGINT AS row_order FROM t UNION ALL SELECT id, place, 'classics', 1 FROM c UNION ALL SELECT id, place, 'new', 2 FROM e WHERE place <= 20"),
    Query("fingerprints", fingerprints, """SELECT p_partkey, sha256('{"name":"' || p_name || '","size":' || p_size || '}') AS digest FROM part"""),
    Query("stream_impressions", stream_impressions, f"WITH {_EV} SELECT DISTINCT user_id, item, CAST(ts AS DATE) AS day FROM ev"),
    Query("stream_latest", stream_latest, "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id"),
    Query("stream_sessions", stream_sessions, f"SELECT user_id, start, events FROM ({_ISLANDS}) WHERE \"last\" + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"),
    Query("stream_metrics", stream_metrics, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY ALL"),
    Query("stream_demand", stream_demand, "SELECT user_id AS id, event_type AS source, max((value > 90)::INT)::BIGINT AS urgent, min(epoch_us(ts))::DOUBLE AS requested, count(*) AS asked FROM events GROUP BY ALL"),
    Query("stream_queue", stream_queue),
    Query("stream_poll", stream_poll),
    Query("stream_expiry", stream_expiry, f"""WITH t AS (SELECT user_id AS key, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before, (SELECT max(epoch_us(ts)) FROM events) AS now FROM (SELECT DISTINCT user_id, ts FROM events)),
        s AS (SELECT *, sum(CASE WHEN before IS NULL OR t > before + {EXPIRY} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t) AS run FROM t),
        r AS (SELECT key, run, min(t) AS start, max(t) AS last, any_value(now) AS now FROM s GROUP BY key, run)
        SELECT key, 'put' AS said, start AS "at" FROM r UNION ALL SELECT key, 'expired', last FROM r x WHERE last + {EXPIRY} + 1000 < now OR EXISTS (SELECT 1 FROM r y WHERE y.key = x.key AND y.run > x.run)"""),
    Query("stream_budget", stream_budget),
    Query("stream_admission", stream_admission, "WITH r AS (SELECT user_id AS key, event_id AS request, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT key, request, round(3600.0 * k + max(t - 3600.0 * k) OVER (PARTITION BY key ORDER BY k ROWS UNBOUNDED PRECEDING), 3) AS start FROM r"),
    Query("stream_high_water", stream_high_water, "SELECT user_id AS id, max(event_id) AS updated FROM events GROUP BY user_id"),
]
