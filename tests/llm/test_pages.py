"""Main text of pages."""

import random

import pytest

from quillon.llm import html_text

PAGES = "page_id long, url string, html string, text string, row long, blocks int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], PAGES)
    return {r.page_id: r for r in html_text.extract_text(df).collect()}


def test_articles(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div>
    <article><header><h1>Caf&eacute; &amp;
      more</h1></header><p><b>First   line &#8212; bold.<br><p>Second&nbsp;line<p>a &lt;b&gt; c</p><aside>Aside</aside><div class="share-buttons share">Share</div>
    <ul><li>one<li>two</ul><table><tr><td>x<td>y</table><form><label>Mail</label><input></form><noscript>js</noscript></article>
    <section class="comments"><article><p>Reader says</p></article></section><div id="cookie-notice" class="notice">Cookies</div><footer>&copy; us</footer></body></html>"""
    got = run(spark, [(1, "http://a.b/x", page)])[1]
    assert got.text == "Café & more\n\nFirst line — bold.\n\nSecond line\n\na <b> c\n\none\n\ntwo\n\nx\n\ny" and got.n_chars == len(got.text)


def test_odd_pages(spark):
    rows = [(1, "http://h/1", None), (2, None, ""), (3, "not a url", "plain words only"), (4, "http://h/2", "<p>cut <b>here</b> <a hre"), (None, "http://h/3", "<article><p>x</p></article>"), (5, "http://h/4", "<article></article>"), (6, "http://h/5", "<article><p>\U0001f600 two</p></article>")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert got[1].text == got[2].text == got[5].text == "" and got[1].n_chars == 0
    assert got[3].text == "plain words only" and got[4].text == "cut here" and got[None].text == "x" and got[6].n_chars == 5
    assert run(spark, []) == {}
    twice = spark.createDataFrame([(1, "http://h/1", "<p>a b</p>")] * 3, "page_id long, url string, html string")
    assert [r.text for r in html_text.extract_text(twice).collect()] == ["a b"] * 3


def test_repeated_runs_of_open_pages_go(spark):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    top, foot = words(12), words(20)
    bodies = [words(60) for _ in range(30)]
    rows = [(k, f"https://one.example/{k}", f"<div>{top}</div><div>{b}</div><div>{foot}</div>") for k, b in enumerate(bodies)]
    rows += [(100, "https://two.example/", f"<div>{top}</div><div>{bodies[0]}</div>")]  # another host: once only
    got = run(spark, rows)
    assert all(got[k].text == b for k, b in enumerate(bodies))
    assert got[100].text == f"{top}\n\n{bodies[0]}"


@pytest.mark.parametrize("sent", [0, 500_000])
def test_articles_stay_whole_and_cores_keep_shared_passages(spark, monkeypatch, sent):
    monkeypatch.setattr(html_text, "SENT_RUNS", sent)
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    notice, quote, bodies = words(15), words(20), [words(50) for _ in range(12)]
    rows = [(k, "https://one.example/", f"<article><p>{b}</p><p>{quote}</p></article><footer>{notice}</footer>") for k, b in enumerate(bodies[:6])]
    rows += [(10, "https://one.example/", f"<article><p>{bodies[6]}</p><p>{notice}</p><p>{notice} {bodies[7]}</p></article>")]
    rows += [(20 + k, "https://one.example/", f"<div>{notice}</div><p>{b}</p><p>{quote}</p><p>{b[::-1]}</p><div>{notice}</div>") for k, b in enumerate(bodies[8:])]
    got = run(spark, rows)
    assert all(got[k].text == f"{b}\n\n{quote}" for k, b in enumerate(bodies[:6]))  # articles may share a passage
    assert got[10].text == f"{bodies[6]}\n\n{notice}\n\n{notice} {bodies[7]}"  # and with frames
    assert all(got[20 + k].text == f"{b}\n\n{quote}\n\n{b[::-1]}" for k, b in enumerate(bodies[8:]))  # inside the core it stays


@pytest.mark.parametrize("sent", [0, 500_000])
def test_articles_go_through_the_arrays_and_the_check(spark, monkeypatch, sent):
    monkeypatch.setattr(html_text, "SENT_RUNS", sent)
    r = random.Random(12)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    notice, tail, bodies = words(15), words(15), [words(50) for _ in range(20)]
    page = lambda inside, foot="": f"<article>{inside}</article><footer>{foot}</footer>"
    rows = [(k, "https://one.example/", page(f"<p>{bodies[k]}</p>", notice)) for k in range(3)]
    rows += [(10, "https://one.example/", page(f"<p>{bodies[10]}</p><div>{notice}</div>"))]
    rows += [(11, "https://one.example/", page(f"<p>{notice} {tail}</p><p>{bodies[11]} {notice}</p>")), (12, "https://one.example/", page(notice))]
    rows += [(13, "https://two.example/", page(f"<p>{bodies[10]}</p><div>{notice}</div>"))]  # another host
    rows += [(14, "https://one.example/", f"<div>{notice} {tail}</div><p>{bodies[13]}</p>"), (15, "https://one.example/", f"<p>{bodies[14]}</p><p>{notice}</p><p>{bodies[15]}</p>")]
    rows += [(20 + k, "https://one.example/", page(f"<p>{bodies[16 + k]}</p><p>{tail}</p>")) for k in range(4)]  # shared by articles only
    rows += [(30, "https://one.example/", ""), (31, "https://one.example/", None), (32, "https://one.example/", "<p>short</p>")]
    got = {k: (x.text, x.n_repeated) for k, x in run(spark, rows).items()}
    assert all(got[k] == (bodies[k], 0) for k in range(3))
    assert got[10] == (f"{bodies[10]}\n\n{notice}", 15) and got[11] == (f"{notice} {tail}\n\n{bodies[11]} {notice}", 30) and got[12] == (notice, 15)
    assert got[13] == (f"{bodies[10]}\n\n{notice}", 0)
    assert got[14] == (f"{tail}\n\n{bodies[13]}", 0) and got[15] == (f"{bodies[14]}\n\n{notice}\n\n{bodies[15]}", 15)
    assert all(got[20 + k] == (f"{bodies[16 + k]}\n\n{tail}", 0) for k in range(4))
    assert got[30] == got[31] == ("", 0) and got[32] == ("short", 0)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_every_page_of_the_driver_goes_through_the_arrays(spark, middle, monkeypatch, sent):
    from urllib.parse import urlsplit

    monkeypatch.setattr(html_text, "SENT_RUNS", sent)
    pages = spark.read.parquet(f"{middle}/pages.parquet")
    seen, main, n = {}, {}, html_text.RUN
    for p in pages.collect():
        host, (text, frame, article) = urlsplit(p.url).hostname, html_text.page_blocks(p.html)
        assert article
        main[p.page_id], tokens = (host, " ".join(text).split()), " ".join(frame).split()
        for k in range(len(tokens) - n + 1):
            seen.setdefault((host, *tokens[k : k + n]), set()).add((tuple(text), tuple(frame)))
    want = {}
    for page, (host, tokens) in main.items():
        places = [k for k in range(len(tokens) - n + 1) if len(seen.get((host, *tokens[k : k + n]), ())) >= html_text.PAGES]
        want[page] = len({k + d for k in places for d in range(n)})
    got = {r.page_id: r.n_repeated for r in html_text.extract_text(pages).collect()}
    assert got == want and sum(x > 0 for x in want.values()) > 1


def test_keys_of_many_pages_equal_those_of_each():
    import numpy as np
    import pyarrow as pa

    r = random.Random(13)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 3, 9, 8, 7, 30, 1, 0, 8, 40, 2)]
    hosts, hashes = [r.choice(["", "a.b", "c"]) for _ in texts], html_text.WordHashes()
    for few in (texts, texts[:2], texts[:1], texts[5:6], texts[2:4]):
        keys, ends = html_text.run_keys_of(hashes, hosts[: len(few)], pa.array(few))
        each = [html_text.run_keys(hashes, h, t.split(" ")) for h, t in zip(hosts, few)]
        assert ends.tolist() == np.cumsum([len(t.split(" ")) for t in few]).tolist()
        assert keys[html_text.starts_run(len(keys), ends)].tolist() == np.concatenate(each).tolist()


def test_a_very_long_page(spark):
    r = random.Random(4)
    body = [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)) for _ in range(400)]
    got = run(spark, [(1, "http://h/", "<article>" + "".join(f"<p>{b}" for b in body) + "</article>"), (2, "http://h/", "<div>" + "".join(f"<p>{b}" for b in body) + "</div>")])
    assert got[1].text == got[2].text == "\n\n".join(body)


def test_a_host_larger_than_an_array(spark, monkeypatch):
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    top, bodies = words(10), [words(40) for _ in range(40)]
    rows = [(k, "https://one.example/", f"<p>{top}</p><p>{b}</p>") for k, b in enumerate(bodies)]
    streams = spark.createDataFrame([("one.example", k, f"{top} {b}".split()) for k, b in enumerate(bodies)], "host string, page int, tokens array<string>")
    whole = {x.run for x in html_text.boilerplate(streams).collect()}
    monkeypatch.setattr(html_text, "ARRAY_TOKENS", 120)
    assert {x.run for x in html_text.boilerplate(streams.repartition(1)).collect()} == whole and len(whole) == 3
    assert all(run(spark, rows)[k].text == b for k, b in enumerate(bodies[:3]))


def test_suffix_arrays_equal_plain_counts():
    r = random.Random(9)
    streams = [[r.choice("ab") for _ in range(r.randrange(0, 40))] for _ in range(12)]
    want = {}
    for s, tokens in enumerate(streams):
        for k in range(len(tokens) - html_text.RUN + 1):
            want.setdefault(tuple(tokens[k : k + html_text.RUN]), set()).add(s)
    got = {tuple(streams[s][p : p + html_text.RUN]): c for s, p, c in html_text.repeated_prefixes(streams)}
    assert got == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("folder", ["small", "middle"])
def test_pages_of_the_driver(spark, folder, request):
    import html
    import re

    pages = spark.read.parquet(f"{request.getfixturevalue(folder)}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for p in pages.collect():
        body = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[p.page_id] == "\n\n".join(b for b in blocks if b)
