"""Main text of web pages: markup gives the candidates, suffix arrays find the boilerplate among them, markup checks.

A page is parsed once. A page with an article or main element has the blocks inside as candidates, without the parts that
are a menu, a form, comments and so on. A page without one is open: all its blocks outside such parts are candidates. The
token streams of each page of a host (the frame of an article page, all of an open one) are laid end to end in suffix
arrays: a run of RUN tokens that stands on at least PAGES different pages is boilerplate. A token stands in a repeated
substring of RUN tokens or more exactly if it stands in such a run, so suffixes are sorted to that depth and no further.
The candidates of every page are searched for the runs. A page has a core, the stretch of blocks with most tokens that are
not covered above those that are. The core stays whole; outside of it covered tokens go and unique runs stay.

A check by markup follows: what an article holds outside of frame parts is its text, so covered tokens of an article come
back. Articles share whole passages with each other and with frames, and without the check arrays take out parts of them
(figures in the README). n_repeated tells of each page how many covered tokens its text holds.

Arrays are bounded in size: each gives the runs of its pages with their counts, and the counts of a host are added up
over its arrays, so no host has to fit in one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, materialise, run_hashes, slices, texts_of

#: Tokens of a repeated run, and pages with different streams that must have it; tokens of one suffix array.
RUN, PAGES, ARRAY_TOKENS = 8, 3, 1 << 20

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are never main text, whatever they stand in.
DROPPED = frozenset("aside button canvas dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id, and roles, that mark a part as frame.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsbygoogle|banner|breadcrumbs?|comments?|commentlist|cookies?|copyright|disclaimer|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_SPACE = re.compile(r"\s+")
_CUT = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?$")
#: A start tag of these ends an open element of the first kind.
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}


class Page(HTMLParser):
    """Blocks of one page as (text, inside an article, dropped)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, inside an article, dropped
        self.parts: list[tuple[str, bool]] = []  # text of the open block, dropped
        self.blocks: list[tuple[str, bool, bool]] = []
        self.has_article = False
        self.feed(_CUT.sub("", html))
        self.close()
        self.flush()

    def flush(self) -> None:
        """Close the block: its text, and as a block of its own what was dropped inside it."""
        parts, self.parts = self.parts, []
        for dropped in (False, True):
            text = _SPACE.sub(" ", "".join(t for t, d in parts if d == dropped)).strip()
            if text:
                self.blocks.append((text, self.state()[0], dropped))

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            ends = CLOSES.get(tag, frozenset(["p"]))
            for k in range(len(self.stack) - 1, -1, -1):  # with the inline elements left open in it
                if self.stack[k][0] in ends:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCKS:
                    break
        elif tag == "br":
            self.parts.append((" ", self.state()[1]))
        if tag in VOID:
            return
        article, dropped = self.state()
        found = {k: v or "" for k, v in attrs}
        role = found.get("role", "").lower()
        own = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
        if own and not dropped:
            self.has_article = True
        marks = {m.lower().strip(" _-") for name in ("class", "id") for m in MARKS.findall(found.get(name, ""))}
        if article:  # an article's own header holds its title
            marks -= {"header"}
        marked = tag not in ("html", "body", "article", "main") and bool(marks)
        outer_header = tag == "header" and not article
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        self.stack.append((tag, article or (own and not dropped), dropped or tag in DROPPED or marked or outer_header or hidden or role in ROLES))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in ("article", "main", "body", "table") and tag not in BLOCKS:
                return  # a stray end tag of an inline element closes nothing around it

    def handle_data(self, data: str) -> None:
        if not self.stack or self.stack[-1][0] not in ("script", "style"):
            self.parts.append((data, self.state()[1]))


def page_blocks(html: str) -> tuple[list[str], list[str], bool]:
    """(candidate blocks of the main text, blocks of the frame, whether an article marks them)."""
    page = Page(html)
    main = [t for t, article, dropped in page.blocks if not dropped and (article or not page.has_article)]
    frame = [t for t, article, dropped in page.blocks if dropped or (page.has_article and not article)]
    return main, frame, page.has_article


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def repeated_prefixes(streams: list[list[str]]) -> list[tuple[int, int, int]]:
    """(stream, place, streams that have it) for each distinct run of RUN tokens: one suffix array over all streams,
    sorted to the depth of RUN tokens by doubling."""
    sizes = np.array([len(s) for s in streams], np.int64)
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(t, len(number)) for s in streams for t in s), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(streams)), sizes)
    place = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = np.repeat(sizes, sizes) - place >= RUN
    depth = 1
    while depth < RUN:
        step = min(depth, RUN - depth)
        ahead = np.append(rank[step:], np.zeros(step, np.int64)) if len(rank) > step else np.zeros(len(rank), np.int64)
        _, rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64), return_inverse=True)
        depth += step
    at = np.flatnonzero(fits)
    if not len(at):
        return []
    order = at[np.lexsort((owner[at], rank[at]))]  # the suffix array, equal prefixes by stream
    new = np.append(True, np.diff(rank[order]) != 0)
    other = new | np.append(True, np.diff(owner[order]) != 0)
    starts = np.flatnonzero(new)
    count = np.add.reduceat(other.astype(np.int64), starts)
    return list(zip(owner[order[starts]].tolist(), place[order[starts]].tolist(), count.tolist(), strict=True))


def run_keys(hashes: WordHashes, host: str, tokens: list[str]) -> np.ndarray:
    """For each place the hash of the host and the run of RUN tokens there."""
    seed = np.uint64(hashes[b"\x00" + host.encode("utf-8", "surrogatepass")])
    return (run_hashes(hashes.of([t.encode("utf-8", "surrogatepass") for t in tokens]), RUN) ^ seed).view(np.int64)


def boilerplate(streams: DataFrame) -> DataFrame:
    """streams: host, page, tokens. The runs that are boilerplate, by run_keys: run. Streams of the same host and page count
    once."""

    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, host, held, n = WordHashes(), None, [], 0

        def close() -> pa.RecordBatch:
            found = np.array(repeated_prefixes(held), np.int64).reshape(-1, 3)
            keys = [run_keys(hashes, host, tokens) for tokens in held]
            start = np.cumsum([0, *(len(k) for k in keys)])
            run = np.concatenate([*keys, np.zeros(0, np.int64)])[start[found[:, 0]] + found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(run), pa.array(found[:, 2])], ["run", "pages"])

        for batch in slices(batches, 256):
            for h, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (h != host or n + len(tokens) > ARRAY_TOKENS):
                    yield close()
                    held, n = [], 0
                host = h
                held.append(tokens)
                n += len(tokens)
        if held:
            yield close()

    distinct = streams.groupBy("host", "page").agg(F.min("tokens").alias("tokens"))
    # by host and page: a host with most of the pages is spread over the tasks, each of which sorts its own by host
    runs = distinct.sortWithinPartitions("host").select("host", "tokens").mapInArrow(arrays, "run long, pages long")
    return runs.groupBy("run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("run")


def run_keys_of(hashes: WordHashes, hosts: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts, each a page's blocks joined by spaces: the hash of host and run at each token, as run_keys has it where
    starts_run is true, and where the tokens of each text end."""
    words = pc.split_pattern(texts, " ")
    ends = words.offsets.to_numpy().astype(np.int64)[1:] - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    found = hashes.of([w.encode("utf-8") for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    seeds = hashes.of([b"\x00" + h.encode("utf-8", "surrogatepass") for h in hosts])
    keys = run_hashes(found, RUN)
    return (keys ^ np.repeat(seeds, np.diff(ends, prepend=0))[: len(keys)]).view(np.int64), ends


def starts_run(n: int, ends: np.ndarray) -> np.ndarray:
    """At which of the first n tokens a run can start that lies in one of the texts which end there."""
    out = np.ones(n, bool)
    for k in range(1, RUN):
        at = ends - k
        out[at[(at >= 0) & (at < n)]] = False
    return out


def covered_tokens(n: int, places: np.ndarray) -> np.ndarray:
    """Which of n tokens a run covers that starts at one of the places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + RUN, -1)
    return np.cumsum(steps[:n]) > 0


def kept_blocks(blocks: list[str], article: bool, covered: np.ndarray) -> tuple[list[str], int]:
    """The blocks of a page that stay, and how many of their tokens are covered. covered: for each token of the blocks, one
    after the other. article: whether they are the blocks of an article, all of which the check gives back."""
    tokens = [b.split(" ") for b in blocks]
    ends = np.cumsum([len(t) for t in tokens])
    parts = np.split(covered, ends[:-1]) if blocks else []
    # the core: blocks first to last - 1, where the sum of gains is largest
    total, low, start, best, core = 0, 0, 0, 0, (0, 0)
    for k, c in enumerate(parts):
        total += len(c) - 2 * int(c.sum())
        if total - low > best:
            best, core = total - low, (start, k + 1)
        if total <= low:
            low, start = total, k + 1
    out, repeated = [], 0
    for k, (block, words, c) in enumerate(zip(blocks, tokens, parts, strict=True)):
        if article or core[0] <= k < core[1]:
            out.append(block)
            repeated += int(c.sum())
        elif not c.all():
            out.append(" ".join(w for w, gone in zip(words, c.tolist(), strict=True) if not gone))
    return out, repeated


def held(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the asked are among the sorted values."""
    if not len(values):
        return np.zeros(len(asked), bool)
    return values[np.minimum(np.searchsorted(values, asked), len(values) - 1)] == asked


#: Runs up to which boilerplate is sent to every task, 8 bytes each; beyond, the pages' runs are joined to it.
SENT_RUNS = 500_000
#: Bits of the maps that leave most runs of the pages and pages without boilerplate out of that join, a power of two.
MAP_BITS = 1 << 27


def bit_map(runs: DataFrame) -> np.ndarray:
    """A bit for each value of the lowest bits of a run, set where there is such a run. Has a fixed size."""
    word, bit = F.expr(f"shiftright(run & {MAP_BITS - 1}, 6)").alias("word"), F.expr("shiftleft(1L, cast(run & 63 AS int))").alias("bit")
    got = runs.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[got["word"].to_numpy()] = got["bit"].to_numpy()
    return out.view(np.uint64)


def in_map(bits: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether the bit of each run is set."""
    low = runs.view(np.uint64) & np.uint64(MAP_BITS - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", by_arrays: bool = True) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by an empty line), n_chars (code points), n_repeated (words of the text that
    stand in runs which are boilerplate of the host, and that its core or the check by markup keeps).

    Null html is empty: empty text. Null and repeated keys and urls stay rows of their own, of repeated pages each; pages
    without a host form one group; very long pages are taken whole; no rows, no result. Other columns are left out.
    by_arrays=False leaves the suffix arrays out, to measure them; n_repeated is 0."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            main, frame, article = zip(*map(page_blocks, texts_of(batch.column(2))), strict=True) if batch.num_rows else ([], [], [])
            lists = [pa.array(list(x), pa.list_(pa.string())) for x in (main, frame)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(list(article), pa.bool_()), *lists], ["page_id", "url", "host", "article", "main", "frame"])

    def strip(sent: Callable[[], np.ndarray] | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Over page_id, url, host, article, main, and where the runs aren't sent the places of boilerplate."""

        def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, runs = WordHashes(), sent() if sent else None
            for batch in slices(batches, 256):
                main = batch.column(4)
                if sent:
                    keys, ends = run_keys_of(hashes, batch.column(2).to_pylist(), pc.binary_join(main, " "))
                    places = np.flatnonzero(held(runs, keys) & starts_run(len(keys), ends))
                else:
                    ends = np.cumsum(pc.add(pc.count_substring(pc.binary_join(main, " "), " "), 1).to_numpy().astype(np.int64))
                    counts = batch.column(5).value_lengths().fill_null(0).to_numpy()
                    places = batch.column(5).flatten().to_numpy() + np.repeat(ends - np.diff(ends, prepend=0), counts)
                texts, repeated = pc.binary_join(main, "\n\n").to_pylist(), [0] * batch.num_rows
                for k, c in enumerate(np.split(covered_tokens(int(ends[-1]), places), ends[:-1])):
                    if c.any():
                        blocks, repeated[k] = kept_blocks(main[k].as_py(), batch.column(3)[k].as_py(), c)
                        texts[k] = "\n\n".join(blocks)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(repeated, pa.int64())], ["page_id", "url", "text", "n_repeated"])

        return of

    def runs_of(sent: Callable[[], np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Over row, host, main: each run of a page whose bit is set, as row, place, run."""

        def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, bits = WordHashes(), sent()
            for batch in slices(batches, 256):
                keys, ends = run_keys_of(hashes, batch.column(1).to_pylist(), pc.binary_join(batch.column(2), " "))
                places = np.flatnonzero(in_map(bits, keys) & starts_run(len(keys), ends))
                page = np.searchsorted(ends, places, side="right")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page)), pa.array(places - (ends - np.diff(ends, prepend=0))[page]), pa.array(keys[places])], ["row", "place", "run"])

        return of

    def marked(sent: Callable[[], np.ndarray], has: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Over rows that end in mark: those whose bit is set, or not set."""

        def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent()
            for batch in batches:
                yield batch.filter(pa.array(in_map(bits, batch.column(batch.num_columns - 1).to_numpy()) == has))

        return of

    spark = pages.sparkSession
    bounded_batches(spark)
    whole = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    parsed = whole.mapInArrow(parse, "page_id long, url string, host string, article boolean, main array<string>, frame array<string>")
    if not by_arrays:
        text = parsed.select("page_id", "url", F.array_join("main", "\n\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
    else:
        parsed = materialise(parsed.withColumn("row", F.monotonically_increasing_id()))
        tokens = F.split(F.array_join(F.when(F.col("article"), F.col("frame")).otherwise(F.concat("main", "frame")), " "), " ")
        streams = parsed.select("host", F.xxhash64("main", "frame").alias("page"), tokens.alias("tokens"))
        found = materialise(boilerplate(streams.where(F.size("tokens") >= RUN)))
        asked = parsed.select("page_id", "url", "host", "article", "main", "row")
        kept = "page_id long, url string, text string, n_repeated long"
        if found.count() <= SENT_RUNS:
            shared = spark.sparkContext.broadcast(np.sort(np.array([r.run for r in found.collect()], np.int64)))
            text = asked.drop("row").mapInArrow(strip(lambda: shared.value), kept)
        else:
            bits = spark.sparkContext.broadcast(bit_map(found))
            runs = parsed.select("row", "host", "main").mapInArrow(runs_of(lambda: bits.value), "row long, place long, run long")
            places = materialise(runs.join(found, "run").groupBy("row").agg(F.collect_list("place").alias("places")))
            # only the texts of pages with boilerplate are shuffled
            rows = spark.sparkContext.broadcast(bit_map(places.select(F.xxhash64("row").alias("run"))))
            asked = asked.withColumn("mark", F.xxhash64("row"))
            clean = asked.mapInArrow(marked(lambda: rows.value, False), asked.schema).select("page_id", "url", F.array_join("main", "\n\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
            text = asked.mapInArrow(marked(lambda: rows.value, True), asked.schema).drop("mark").join(places, "row", "left").drop("row").mapInArrow(strip(None), kept).union(clean)
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
