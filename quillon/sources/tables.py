"""Reading and writing the library's tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; where that is unset and the master is local
    (tests), under a temporary folder that becomes the session's."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a checkpoint in spark.checkpoint.dir; where that is unset, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def never_broadcast(df: DataFrame) -> DataFrame:
    """df, whose joins are by sort and merge. Spark guesses how large a table is from its compressed files, and takes what is
    exploded from a small file for small: it would send millions of rows to the driver and on to every executor."""
    return df.hint("merge")


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Rows numbered from 0 in the order given: ranges of the order are sorted apart, and each adds the sizes of those
    before it, so no task sorts the whole table."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(before, "_range").withColumn(name, F.col("_before") + F.col("_within")).select(*df.columns, name)


def running_total(df: DataFrame, order: Sequence[str], amount: str, name: str = "before") -> DataFrame:
    """Adds the sum of `amount` over the rows before each in the order given (distinct), and `name`_all, the sum of all
    rows: ranges of the order are summed apart, so no task has the whole table."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(amount).alias("_n"))
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = sums.select("_range", F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_within", within).join(before, "_range")
    return out.select(*df.columns, (F.col("_before") + F.col("_within")).alias(name), F.col("_all").alias(f"{name}_all"))


# ------------------------------------------------------------------ catalogue pages


def show_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw shows of JSON pages (arrays of objects). Only the schema's fields are parsed."""
    return spark.read.schema(schemas.SHOW).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def channels(shows: DataFrame) -> DataFrame:
    """id, channel ('network:1' or 'web:2'), name of each show's network and web channel."""
    both = F.explode(F.array(F.struct(F.lit("network").alias("kind"), F.col("network.id").alias("cid"), F.col("network.name").alias("name")), F.struct(F.lit("web").alias("kind"), F.col("webChannel.id").alias("cid"), F.col("webChannel.name").alias("name"))))
    return shows.select("id", both.alias("c")).where("c.cid is not null").select("id", F.concat("c.kind", F.lit(":"), F.col("c.cid").cast("string")).alias("channel"), "c.name")


def external_ids(shows: DataFrame) -> DataFrame:
    """id, imdb of the shows with a well-formed external id."""
    return shows.where(F.col("externals.imdb").rlike(r"^tt\d{5,10}$")).select("id", F.col("externals.imdb").alias("imdb"))


def clickstream(spark: SparkSession, path: str) -> DataFrame:
    """prev, curr, type, n of a tab-separated file; a malformed count is null. Compressed files can't be split, so the
    rows are dealt out after reading."""
    raw = spark.read.schema("prev string, curr string, type string, n string").option("sep", "\t").option("quote", "").csv(path)
    return raw.withColumn("n", F.expr("try_cast(n as bigint)")).repartition(spark.sparkContext.defaultParallelism)


def month_pairs(clicks: DataFrame, titles: DataFrame, month: str) -> DataFrame:
    """clicks between two known pages (titles: title, id) as month, a, b, n; both directions are one pair."""
    from ..operators.cointerest import pair_counts

    known = clicks.join(titles.select(F.col("title").alias("prev"), F.col("id").alias("from")), "prev").join(titles.select(F.col("title").alias("curr"), F.col("id").alias("to")), "curr")
    return pair_counts(known, "from", "to", "n").select(F.lit(month).alias("month"), "a", "b", "n")


def aliases(spark: SparkSession, path: str, longest: int = 150, most: int = 100) -> DataFrame:
    """id, names of a JSON file {"version": 1, "aliases": {id: [names]}}; anything else gives no rows."""
    raw = spark.read.schema("version int, aliases map<string, array<string>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("version = 1 and aliases is not null")
    rows = raw.select(F.explode("aliases").alias("key", "names")).where(F.col("key").rlike(r"^\d{1,9}$"))
    kept = F.slice(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n.isNotNull() & F.length(n).between(1, longest)), 1, most)
    return rows.select(F.expr("cast(key as long)").alias("id"), F.transform(kept, lambda n: F.replace(n, F.lit("\n"), F.lit(" "))).alias("names")).where(F.size("names") > 0)


def show_records(shows: DataFrame, snapshot: str, genres: Sequence[str], themes: Sequence[str], seeds: Sequence[str] = ()) -> DataFrame:
    """The catalogue: coalesced channel, runtime and year, cleaned summary, flag sets, and whether a show may be
    recommended. Words and flags are of the summary without the own title and the seeds' titles. themes: patterns. Zero
    counts as missing, as an empty string does."""
    from ..functions import bits, buckets, text

    web, net = F.col("webChannel"), F.col("network")
    summary = text.clean_html(F.coalesce("summary", F.lit("")))
    plot = text.remove_title(summary, F.coalesce("name", F.lit("")))
    for seed in seeds:
        plot = text.remove_title(plot, F.lit(seed))
    d = shows.withColumn("_plot", plot).withColumn("_summary", summary)
    words = F.size(F.filter(F.split("_plot", " "), lambda w: w != ""))
    has_genres = F.size(F.coalesce("genres", F.array().cast("array<string>"))) > 0
    return d.select(
        "id", "name", F.expr("try_cast(substring(premiered, 1, 4) as int)").alias("year"), "premiered", F.coalesce(F.nullif("averageRuntime", F.lit(0)), F.nullif("runtime", F.lit(0))).alias("runtime"),
        F.col("rating.average").alias("rating"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), "status", "language", "type",
        F.coalesce(net["country"]["code"], web["country"]["code"]).alias("country"), F.coalesce(web["name"], net["name"]).alias("channel"), "url",
        F.when(F.length("_summary") > 480, F.concat(F.substring("_summary", 1, 480), F.lit("…"))).otherwise(F.col("_summary")).alias("summary"), words.alias("summary_words"),
        bits.encode(F.col("genres"), genres).alias("genre_bits"), bits.pattern_flags(F.col("_plot"), themes).alias("theme_bits"),
        buckets.recommendable(F.col("premiered"), words, has_genres, snapshot).alias("recommendable"), buckets.coverage_label(words, has_genres).alias("coverage"),
    )


# ------------------------------------------------------------------ sinks


def write_matrix(df: DataFrame, row_table: str, col_table: str, row: str = "row", col: str = "col", buckets: int = 64, folder: str | None = None) -> None:
    """A long matrix twice, bucketed by row and by column, so that joins and sums on either need no shuffle. folder: where the
    tables' files go, if not to the warehouse."""
    for name, key in ((row_table, row), (col_table, col)):
        writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)


def read_matrix(spark: SparkSession, row_table: str, col_table: str) -> tuple[DataFrame, DataFrame]:
    """Both copies of a matrix, once it is clear that they hold the same cells: as many, with the same sums of hashes of all
    columns. Copies that differ raise."""
    both = [spark.table(name) for name in (row_table, col_table)]
    names = sorted(both[0].columns)
    told = [t.agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *names))).first() for t in both]
    if sorted(both[1].columns) != names or told[0] != told[1]:
        raise ValueError(f"{row_table} and {col_table} hold different cells")
    return both[0], both[1]


def publish(df: DataFrame, root: str, name: str, checks: Sequence[DataFrame] = ()) -> str:
    """Write a new version under root/name, hold it against the checks (each must be empty), and make it current by a
    pointer file that is replaced as a whole; on a violation the last version stays current."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    path = f"{root}/{name}/versions/{version}"
    df.write.parquet(path)
    for k, check in enumerate(checks):
        if not check.isEmpty():
            raise ValueError(f"{name}: check {k} found violations; version {version} is not published")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/{name}/current")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/{name}/current").first()[0]
    return spark.read.parquet(f"{root}/{name}/versions/{version}")


def prune(spark: SparkSession, root: str, name: str, keep: int = 3) -> list[str]:
    """Remove all but the newest `keep` versions of root/name and, whatever its age, the current one. Returns what went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/versions")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    live = spark.read.schema("version string").json(f"{root}/{name}/current").first()[0]
    found = sorted(((f.getModificationTime(), f.getPath().getName()) for f in files.listStatus(path)), reverse=True)
    gone = [v for _, v in found[keep:] if v != live]
    for version in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, version), True)
    return gone


def write_report(df: DataFrame, folder: str, order: Sequence[str], kind: str = "csv") -> None:
    """A small result as one sorted CSV or JSON file, the same bytes for the same rows."""
    one = df.coalesce(1).sortWithinPartitions(*order)
    (one.write.mode("overwrite").option("header", True).csv(folder) if kind == "csv" else one.write.mode("overwrite").json(folder))


def write_facets(values: DataFrame, aliases: DataFrame, folder: str) -> None:
    """Facet values by family, their tokens with document frequencies, and aliases, as three tables."""
    values.write.mode("overwrite").partitionBy("family").parquet(f"{folder}/facet_values")
    values.select("family", "token", "df").distinct().write.mode("overwrite").parquet(f"{folder}/facet_tokens")
    aliases.write.mode("overwrite").parquet(f"{folder}/aliases")


# ------------------------------------------------------------------ landed provider payloads


def sparql_rows(spark: SparkSession, path: str) -> DataFrame:
    """item, prop, value of landed query results ({"results": {"bindings": [{"item": {"value": ..}, ..}]}}); addresses
    become their last part."""
    cell = "struct<value: string>"
    raw = spark.read.schema(f"results struct<bindings: array<struct<item: {cell}, prop: {cell}, value: {cell}>>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    rows = raw.select(F.explode("results.bindings").alias("b")).where("b.item.value is not null and b.prop.value is not null and b.value.value is not null")
    return rows.select(last(F.col("b.item.value")).alias("item"), last(F.col("b.prop.value")).alias("prop"), last(F.col("b.value.value")).alias("value")).distinct()


def facts(triples: DataFrame, properties: dict[str, tuple[str, float]]) -> DataFrame:
    """item, family, value, multiplier of the triples whose property names a family; the highest multiplier of each."""
    known = triples.sparkSession.createDataFrame([(p, f, float(m)) for p, (f, m) in properties.items()], "prop string, family string, multiplier double")
    return triples.join(F.broadcast(known), "prop").groupBy("item", "family", "value").agg(F.max("multiplier").alias("multiplier"))


def entity_labels(names: DataFrame) -> DataFrame:
    """names: item, lang, text. item, label: the English label, else the default one (mul), else that which most languages
    share, of these the shortest and then the first. White space is one space; items without any text have no label."""
    clean = names.select("item", "lang", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("label")).where("item IS NOT NULL AND label <> ''").distinct()
    counted = clean.groupBy("item", "label").agg(F.min(F.when(F.col("lang") == "en", 0).when(F.col("lang") == "mul", 1).otherwise(2)).alias("kind"), F.count("*").alias("n"))
    shared = F.when(F.col("kind") == 2, -F.col("n")).otherwise(0)
    return counted.groupBy("item").agg(F.min_by("label", F.struct("kind", shared, F.when(F.col("kind") == 2, F.length("label")).otherwise(0), "label")).alias("label"))


def typed_hops(facts: DataFrame, triples: DataFrame, weights: dict[str, float], levels: int = 2) -> DataFrame:
    """facts: item, value, multiplier; triples: item, prop, value. What items carry themselves, and what that belongs to over
    up to `levels` statements of the properties weighted here: item, value, multiplier (of the best path: the product of
    its weights), hops (of the shortest of such paths). Statements about themselves, and ways back to the item, count for nothing."""
    known = triples.sparkSession.createDataFrame([(p, float(w)) for p, w in weights.items()], "prop string, w double")
    edges = triples.join(F.broadcast(known), "prop").where("item <> value").groupBy("item", "value").agg(F.max("w").alias("w"))
    edges = materialise(edges.select(F.col("item").alias("at"), F.col("value").alias("to"), "w"))
    level = facts.groupBy("item", "value").agg(F.max("multiplier").alias("multiplier")).withColumn("hops", F.lit(0))
    every = level
    for k in range(levels):
        level = level.join(edges, level["value"] == edges["at"]).where("to <> item").groupBy("item", F.col("to").alias("value")).agg(F.max(F.col("multiplier") * F.col("w")).alias("multiplier")).withColumn("hops", F.lit(k + 1))
        every = every.union(level)
    best = F.max_by(F.struct("multiplier", "hops"), F.struct(F.round("multiplier", 9), -F.col("hops")))
    return every.groupBy("item", "value").agg(best.alias("b")).select("item", "value", "b.*")


def found_films(films: DataFrame, least: int) -> DataFrame:
    """films: qid, kind (film or series), title, year, links, animated. Those with enough links, one row each: a series
    wins over a film, and the earliest year counts."""
    kept = films.where(F.col("links") >= least)
    first = F.min_by(F.struct("kind", "title", "links"), F.struct((F.col("kind") != "series").cast("int"), "title"))
    return kept.groupBy("qid").agg(first.alias("f"), F.min("year").alias("year"), F.max("animated").alias("animated")).select("qid", "f.*", "year", "animated")


def provider_index(raw: DataFrame) -> DataFrame:
    """raw: id, weight, imdb, tvdb as strings. Weight clamped to 0..100, an unknown one null, malformed ids null, rows without
    an id left out."""
    weight = F.expr("try_cast(weight as double)")
    return raw.select(
        F.expr("try_cast(id as bigint)").alias("id"), F.when(weight.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), weight))).alias("weight"),
        F.when(F.col("imdb").rlike(r"^tt\d{5,10}$"), F.col("imdb")).alias("imdb"), F.expr("try_cast(tvdb as bigint)").alias("tvdb"),
    ).where("id is not null")


def updates_since(updates: DataFrame, seen: int) -> DataFrame:
    """id, updated of well-formed entries changed after the mark, newest first where order matters."""
    return updates.select(F.expr("try_cast(id as bigint)").alias("id"), F.expr("try_cast(updated as bigint)").alias("updated")).where((F.col("id") > 0) & (F.col("updated") > seen))


def update_window(gap_seconds: Column) -> Column:
    """The shortest list of changes that covers a gap."""
    return F.when(gap_seconds < 86_400, "day").when(gap_seconds < 7 * 86_400, "week").otherwise("month")


def art_track(catalogue: DataFrame, images: DataFrame, key: str, url: str, bucket: int = 2500, ended: str | None = None) -> DataFrame:
    """key, image (0: none) for every row: the number in an image address (.../<bucket>/<number>.jpg) counts only where
    the bucket is the number's own. ended: a text column of images; adds ended, the year it starts with (0: unknown)."""
    number, own = F.regexp_extract(url, r"/(\d+)\.\w+$", 1), F.regexp_extract(url, r"/(\d+)/\d+\.\w+$", 1)
    cast = lambda c: F.try_to_number(c, F.lit("999999999999")).cast("long")
    right = F.when(F.floor(cast(number) / bucket) == cast(own), cast(number))
    year = [F.nullif(F.regexp_extract(ended, r"^(\d{4})", 1), F.lit("")).cast("int").alias("ended")] if ended else []
    out = catalogue.select(key).join(images.select(key, right.alias("image"), *year), key, "left").withColumn("image", F.coalesce("image", F.lit(0)).cast("long"))
    return out.withColumn("ended", F.coalesce("ended", F.lit(0))) if ended else out


def vocabularies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, values: the sorted distinct known values of each column; columns of few values."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")).select("v.*").where("value is not null")
    return long.distinct().groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values"))


_PAYLOAD = "id long, name string, score double, region string, providers array<struct<id: long, name: string, kind: string, priority: int>>, ratings array<struct<region: string, rating: string>>"


def trimmed(payloads: DataFrame, key: str, json: str, region: str, most_name: int = 200) -> DataFrame:
    """Provider payloads (JSON strings) cut to what is used: name, score within 0..10, the region's rating, and each
    provider once, by kind (flatrate, free, ads, rent, buy) and priority. What does not parse gives nulls."""
    kinds = F.array(*(F.lit(k) for k in ("flatrate", "free", "ads", "rent", "buy")))
    p = payloads.select(key, F.from_json(json, _PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    rating = F.filter(F.coalesce("p.ratings", F.array().cast("array<struct<region: string, rating: string>>")), lambda r: (r["region"] == region) & (F.length(r["rating"]) > 0))
    listed = F.filter("p.providers", lambda x: (x["id"] > 0) & (F.array_position(kinds, x["kind"]) > 0))
    keyed = F.array_sort(F.transform(listed, lambda x: F.struct(F.array_position(kinds, x["kind"]).alias("k"), F.coalesce(x["priority"], F.lit(999)).alias("priority"), x["id"].alias("id"))))
    once = F.array_distinct(F.transform(keyed, lambda x: x["id"]))
    return p.select(key, F.substring("p.name", 1, most_name).alias("name"), F.when(F.col("p.score").between(0, 10), F.col("p.score")).alias("score"), F.try_element_at(rating, F.lit(1))["rating"].alias("rating"), F.coalesce(once, F.array().cast("array<bigint>")).alias("providers"))
