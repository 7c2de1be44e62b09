"""Extraction, repair, conversion, checks, robots, assets, events and crawl order on small cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import assets, events, markdown, robots
from pagemill.operators.dom import find, parse, serialize
from pagemill.operators.extract import ExtractParams, extract
from pagemill.operators.sanitize import sanitize
from pagemill.plans import catalog, crawl, documents

LONG = "Enough words to make this paragraph count as meaningful content of a page. "


def body(html: str):
    return find(parse(html), "body")


@pytest.mark.parametrize(
    ("html", "layer", "selector"),
    [
        (f"<main><p>{LONG}</p></main>", 1, "main"),
        (f"<main></main><article><p>{LONG}</p></article>", 1, "article"),
        (f"<div role=main><p>{LONG}</p></div>", 1, "[role='main']"),
        (f"<div class=markdown-body><p>{LONG}</p></div>", 2, ".markdown-body"),
        (f"<nav>x</nav><div><h1>T</h1><p>{LONG}</p></div>", 3, "div"),
        ("<nav><a href=/a>a</a></nav>", None, None),
        ("plain text only", None, None),
    ],
)
def test_layers(html, layer, selector):
    found = extract(html)
    assert (found.layer, found.selector) == (layer, selector)
    assert (found.cause is None) == (layer is not None)


def test_custom_selectors_and_blacklist():
    html = f"<div id=x><p>{LONG}</p></div><div class=own><p>{LONG}</p><p class=ad>buy</p></div>"
    found = extract(html, ExtractParams(selectors=(".own",), blacklist=(".ad",)))
    assert found.selector == ".own" and "buy" not in found.node.text()


@pytest.mark.parametrize(
    ("html", "cause"),
    [
        ("<body></body>", "unparseable html"),
        ("<body><main><h1>a</h1></main><main>b</main></body>", "competing document roots"),
        ("<body><article><h1>a</h1></article><article>b</article></body>", "competing document roots"),
        ("<body><p>a</p></body>", "no structural anchor"),
        ("<body><h1>a</h1><h1>b</h1></body>", "multiple h1 without primary root"),
    ],
)
def test_beyond_repair(html, cause):
    assert sanitize(body(html)).cause == cause


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>a</h2><h5>b</h5><h2>c</h2>", "<h1>a</h1><h2>b</h2><h2>c</h2>"),
        ("<p class=Eyebrow-x>k</p><h1>a</h1><p id=eyebrow>l</p>", "<h1>a</h1>"),
        ("<h1>a</h1><p aria-hidden=true>x</p><p aria-hidden=false>y</p>", '<h1>a</h1><p aria-hidden="false">y</p>'),
        ("<h1>a</h1><div><p> </p></div><hr>", "<h1>a</h1><hr>"),
        ("<h1>a</h1><ul><li>1</li><li>1</li><li>2</li></ul>", "<h1>a</h1><ul><li>1</li><li>2</li></ul>"),
        ("<h1>a</h1><pre><i>x</i><i>x</i></pre>", "<h1>a</h1><pre><i>x</i><i>x</i></pre>"),
        ("<h1>a</h1><h2>s</h2><p>x</p><h2>s</h2>", "<h1>a</h1><h2>s</h2><p>x</p><h2>s</h2>"),
    ],
)
def test_repairs(html, want):
    node = sanitize(body(f"<body>{html}</body>")).node
    assert serialize(node) == f"<body>{want}</body>"
    assert serialize(sanitize(body(f"<body>{want}</body>")).node) == f"<body>{want}</body>"


def test_tabs():
    html = "<h1>T</h1><div><div role=tablist><a role=tab aria-controls=q>Two</a><a role=tab>One</a></div><div role=tabpanel id=p><h1>p</h1></div><div role=tabpanel id=q><h3>q</h3></div></div>"
    text = markdown.to_markdown(sanitize(body(f"<body>{html}</body>")).node)
    # the first tab names the second panel; the second tab takes the panel of its own place, the same one
    assert text.startswith("# T") and "## Two" in text and "Two\n\n" in text


def test_links_once_and_of_the_web():
    html = "<h1>a</h1>" + "".join(f"<p><a href='{h}'>{k}</a></p>" for k, h in enumerate(("/x", "#t", "mailto:a@b", "http://h/y", "/x", " ", "javascript:0", "z.html")))
    assert sanitize(body(f"<body>{html}</body>")).links == ["/x", "http://h/y", "z.html"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>T</h1><h3>S</h3><p>a\n  b</p>", "# T\n\n### S\n\na b"),
        ("<p>a</p><ul><li>x</li><li>y</li></ul><p>b</p>", "a\n\n- x\n- y\n\nb"),
        ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
        ("<pre><code class='language-go'>a\n b\n</code></pre>", "```go\na\n b\n```"),
        ("<pre><code>a</code></pre>", "```\na\n```"),
        ("<p>use <code>a_b</code></p>", "use `a_b`"),
        ("<p><a href='/x?y'>t</a> <img src='i.png' alt='A'></p>", "[t](/x?y) ![A](i.png)"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n|---|---|\n| 1 | 2 |"),
        ("<table><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table>", "|   |   |   |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 |  |  |"),
        ("<x-y><p>in</p></x-y>", "in"),
        ("<p><strong>x</strong></p>", "**x**"),
        ("<p style='a'>a</p><p>b</p>", "a\n\nb"),
        ("<figure><img src=i><figcaption>cap</figcaption></figure>", "![](i)\n\ncap"),
        ("<blockquote><p>q</p></blockquote>", "> q"),
    ],
)
def test_markdown(html, want):
    assert markdown.to_markdown(body(f"<body>{html}</body>")) == want


@pytest.mark.parametrize(
    ("text", "cause"),
    [
        (" \n", "empty markdown content"),
        ("## a\n\nb", "broken H1 invariant"),
        ("# a\n\nx\n\n# b", "broken H1 invariant"),
        ("x\n\n# a", "orphan content outside root hierarchy"),
        ("```\n# not one\n```\n\n# a", None),
        ("# a\n\n### b\n\nx", "skipped heading levels"),
        ("# a\n\nx\n\n## b\n\n## c\n\ny", None),
        ("# a\n\nx\n\n### b", "skipped heading levels"),
    ],
)
def test_checks(text, cause):
    assert markdown.check(text) == cause


def test_strict_sections_and_title():
    assert markdown.check("# a\n\nx\n\n## b\n\n## c\n\ny", strict_empty_sections=True) == "empty section"
    assert markdown.title("x\n  # A `b` **c** [d](u)") == "A b c d(u)"


def test_bad_pages_keep_their_row(spark):
    rows = [(1, "https://h/a/b", f"<main><h1>T</h1><p>{LONG}</p></main>"), (2, None, None), (3, "https://h/", f"<main><h1>T</h1><p>{LONG}</p></main>"), (3, "x", ""), (4, "https://h/c", "<p>" + "<div>" * 3000 + LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("stage", F.lit(1))
    got = documents.documents(df).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.stage, r.cause) for r in got} >= {(1, None, None), (2, "fetch", "failed to read response body"), (3, "normalize", "section derivation failed"), (3, "extract", "no content")}
    assert next(r for r in got if r.page_id == 1).section == "a"
    assert documents.documents(df.limit(0)).isEmpty()


# ------------------------------------------------------------------- robots

TXT = "Disallow: /all\n# c\nUser-Agent: Bot\nuser-agent: Other # x\nAllow: /p/ok\nDisallow: /p\nCrawl-delay: 1.5\nUser-agent: *\nDisallow: /*.pdf$\nDisallow: x\nSitemap: https://h/s.xml\n"


def test_parse_and_groups():
    r = robots.parse(TXT)
    assert [g.user_agents for g in r.groups] == [["*"], ["Bot", "Other"], ["*"]] and r.sitemaps == ["https://h/s.xml"]
    assert robots.group_for(r.groups, "bot").crawl_delay_ms == 1500
    assert robots.group_for(r.groups, "BotPlus/2").user_agents == ["Bot", "Other"]
    assert robots.group_for(r.groups, "else").disallows == ["/all"]
    assert robots.group_for(r.groups, "else", merge=True).disallows == ["/all", "/*.pdf$", "x"]


@pytest.mark.parametrize(
    ("agent", "path", "allowed", "reason"),
    [
        ("bot", "/p/x", False, "disallowed_by_robots"),
        ("bot", "/p/ok/y", True, "allowed_by_robots"),
        ("bot", "/q", True, "no_matching_rules"),
        ("z", "/all/a", False, "disallowed_by_robots"),
    ],
)
def test_decisions(spark, agent, path, allowed, reason):
    files = spark.createDataFrame([("https://h", 200, bytearray(TXT.encode()))], "site string, status int, body binary")
    got = robots.decide(spark.createDataFrame([("https://h" + path,)], "url string"), robots.rules(files, agent)).first()
    assert (got.allowed, got.reason) == (allowed, reason)


def test_status_and_wildcards(spark):
    files = spark.createDataFrame(
        [("https://a", 404, None), ("https://b", 503, None), ("https://c", 200, bytearray(b"User-agent: q\nDisallow: /")), ("https://d", 200, bytearray(b"User-agent: *\nDisallow: /a*b\nAllow: /a*b*\nDisallow: /k$"))],
        "site string, status int, body binary",
    )
    urls = ["https://a/x", "https://b/x", "https://c/x", "https://d/a1b", "https://d/a1bc", "https://d/k", "https://d/kk", "https://e/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.allowed, r.reason) for r in robots.decide(df, robots.rules(files, "me")).collect()}
    assert got["https://a/x"] == (True, "empty_rule_set") and got["https://b/x"] == (False, "http server error")
    assert got["https://c/x"] == (True, "user_agent_not_matched") and got["https://e/x"] == (True, "empty_rule_set")
    assert got["https://d/a1b"][0] and got["https://d/a1bc"][0]
    assert not got["https://d/k"][0] and got["https://d/kk"] == (True, "no_matching_rules")


# ------------------------------------------------------------ assets, events


def test_assets(spark):
    refs = lambda *raw: [(r, "image") for r in raw]
    docs = spark.createDataFrame(
        [(1, "https://h/p", "![a](/i.png?v=1) ![b](/gone.png)", refs("/i.png?v=1", "/gone.png")), (2, "https://h/q", "![a](/i.png?v=2) ![c](/same.png)", refs("/i.png?v=2", "/same.png")), (3, "https://h/r", "no image", [])],
        "page_rank long, url string, markdown string, refs array<struct<raw:string,kind:string>>",
    )
    fetched = spark.createDataFrame([("https://h/i.png?v=1", 200, bytearray(b"A")), ("https://h/same.png", 200, bytearray(b"A")), ("https://h/gone.png", 404, None)], "url string, status int, bytes binary")
    got = {r.page_rank: r for r in assets.resolve(docs, fetched).collect()}
    path = got[1].local[0]
    assert path.startswith("assets/images/i-") and path.endswith(".png")
    assert got[1].markdown == f"![a]({path}) ![b](/gone.png)" and got[1].missing == {"https://h/gone.png": "forbidden"}
    assert got[2].markdown == f"![a]({path}) ![c]({path})" and got[3].markdown == "no image" and got[3].local == []
    large = {r.page_rank: r.missing for r in assets.resolve(docs, fetched.withColumn("bytes", F.lit(b"12345")).filter("status = 200"), max_bytes=4).collect()}
    assert set(large[1].values()) == {"asset too large", "network issues"}


def test_assets_of_rows_that_share_or_lack_a_rank(spark):
    ref = [("/i.png", "image"), (None, "image"), ("https://z/j.gif", "image")]
    rows = [(1, "https://a/p", "![x](/i.png)", ref), (1, "https://b/p", "![x](/i.png)", ref), (None, "https://a/p", "![x](/i.png)", ref), (2, None, "![x](/i.png) ![y](https://z/j.gif)", ref), (2, None, None, None), (3, "https://a/p", "", [])]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, "page_rank long, url string, markdown string, refs array<struct<raw:string,kind:string>>").withColumn("use", F.lit("x")).withColumn("path", F.lit("y"))
    got = assets.resolve(docs, None).collect()
    assert len(got) == len(rows) and all(r["use"] == "x" and r["path"] == "y" for r in got)
    by = [(r.page_rank, r.url, r.markdown) for r in got]
    a = next(m for k, u, m in by if k == 1 and u == "https://a/p")
    b = next(m for k, u, m in by if k == 1 and u == "https://b/p")
    assert a != b and "/i.png)" not in a and by.count((1, "https://a/p", a)) == 2 and (None, "https://a/p", a) in by
    two = next(m for k, u, m in by if k == 2 and m is not None)
    assert two.startswith("![x](/i.png) ![y](assets/images/j-") and (2, None, None) in by and (3, "https://a/p", "") in by
    assert assets.resolve(docs.limit(0), None).isEmpty()


def test_schedules_with_jitter_and_backoff(spark):
    df = spark.createDataFrame([("h", k, None, no) for k, no in enumerate([False, True, True, False, True])], "host string, rank int, crawl_delay_ms long, no boolean")
    got = [r.wait_ms for r in events.politeness(df, 1000, refused=F.col("no")).orderBy("rank").collect()]
    assert got == [1000, 1100, 1200, 1000, 1100]
    drawn = [r.x for r in spark.range(300).select(events.jitter_ms(F.col("id"), 9).alias("x")).collect()]
    assert set(drawn) == set(range(10))
    assert spark.range(1).select(events.backoff_ms(F.lit(9), jitter=F.lit(400)).alias("x")).first().x == 10_000


def test_events_and_journal(spark, tmp_path):
    failures = spark.createDataFrame([("https://h/a", "fetch", "forbidden", 0, None), ("https://h/b", "fetch", "5xx", 3, None), ("https://h/c", "extract", "odd", 0, None)], "url string, stage string, cause string, retry_count int, ts timestamp")
    assert {r.cause: (r.policy, r.canonical_cause) for r in events.classified(failures).collect()} == {"forbidden": ("manual", "unknown"), "5xx": ("auto", "unknown"), "odd": ("never", "unknown")}
    path = str(tmp_path / "journal")
    assert events.read_journal(spark, path).isEmpty()
    events.append_journal(events.to_journal(failures), path)
    events.append_journal(events.to_journal(failures), path)
    assert [r.url for r in events.read_journal(spark, path).collect()] == ["https://h/a"] * 2
    log = events.event_log(skip=failures.select("url", F.lit("robots_disallow").alias("reason")), error=failures.select("cause"))
    assert log.count() == 6 and log.filter("kind = 'skip'").select("skip.url").first()[0] is not None
    row = events.stats(failures.select("stage", "cause").unionByName(spark.createDataFrame([(None, None)], "stage string, cause string")), 9).first()
    assert (row.pages_visited, row.pages_processed, row.errors, row.manual_retries) == (9, 1, 3, 1)


# -------------------------------------------------------------------- crawl

WEB = [("https://h/", ["/b", "/a", "https://x/o", "/b#z"]), ("https://h/a", ["/c", "/"]), ("https://h/b", ["/d", "/c?q"]), ("https://h/c", ["/e"]), ("https://h/e", ["/f"])]


def order(found):
    return [r.url.removeprefix("https://h") for r in found.orderBy("depth", "rank").collect()]


def test_crawl_order_and_limits(spark):
    links = spark.createDataFrame(WEB, "url string, links array<string>")
    run = lambda **k: crawl.crawl(links, "https://H/", crawl.CrawlParams(**k))[0]
    assert order(run(max_depth=0, max_pages=0)) == ["/", "/b", "/a", "/d", "/c", "/e", "/f"]
    assert order(run(max_depth=1)) == ["/", "/b", "/a"]
    assert order(run(max_pages=4)) == ["/", "/b", "/a", "/d"]
    assert order(run(max_pages=1)) == ["/"]
    files = spark.createDataFrame([("https://h", 200, bytearray(b"User-agent: *\nDisallow: /c"))], "site string, status int, body binary")
    admitted, skipped = crawl.crawl(links, "https://h/", crawl.CrawlParams(), robots.rules(files, "me"))
    assert order(admitted) == ["/", "/b", "/a", "/d"]
    assert [r.reason for r in skipped.collect()] == ["disallowed_by_robots"] * 2


def test_crawl_query_equals_a_queue(spark, tmp_path):
    web = {f"https://h/{k}": [f"https://h/{k + 1}", f"https://h/{k * 7 % 12}", "https://x/o"] for k in range(12)} | {"https://x/o": ["https://h/20"]}
    rows = [(k, url, "".join(f'<a href="{to}">t</a>' for to in links)) for k, (url, links) in enumerate(web.items())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    depth, queue = {"https://h/0": 0}, ["https://h/0"]
    for url in queue:
        for to in web.get(url, []):
            if to.startswith("https://h/") and to not in depth:
                depth[to] = depth[url] + 1
                queue.append(to)
    assert max(depth.values()) > 3
    assert {r.url: r.depth for r in catalog.crawl_bfs(spark, str(tmp_path)).collect()} == depth


# ------------------------------------------------- pages made to be awkward

N = 40_000
START = f"<main><h1>T</h1><p>{LONG}</p>"


@pytest.mark.parametrize(
    ("html", "stage"),
    [
        (START + "<div>" * N + LONG, None),
        (START + "<span>" * N + LONG, None),
        (f"<h1>T</h1><p>{LONG}</p>" + "<div class=nav>" * N + LONG, None),
        (f"<h1>T</h1><p>{LONG}</p>" + "<header>" * N + LONG, None),
        (START + "<section>" * N + LONG, "sanitize"),
        (START + "<ul><li>" * (N // 2), None),
        (START + "<ul><li>x" * 600, None),
        (START + "<ul><li>x" * (N // 2), "convert"),
        (START + "<blockquote>x" * N, "convert"),
        (START + "<span></span>" * N, None),
        (START + "".join(f"<span id={k}></span>" for k in range(N)), None),
        (START + "<a " * N, None),
        (START + '<a href="' * N, None),
        (START + "<" * N, None),
        (START + "<!-- " * N, None),
        (START + "<script>" + "</script " * N, None),
        (START + "x</b>" * N, None),
        (START + "<p>" + "<b>x" * N, None),
        (START + "<table><tr><td>x" * (N // 3), None),
        (START + "<div><div role=tablist>" + "".join(f"<a role=tab aria-controls=p{k}>t{k}</a>" for k in range(1500)) + "</div>" + "".join(f"<div role=tabpanel id=p{k}><h1>q{k}</h1></div>" for k in range(1500)) + "</div>", None),
    ],
)
def test_large_and_deep_pages_cost_little(html, stage):
    began = time.process_time()
    got = documents.document(html)
    assert time.process_time() - began < 12  # seconds on a slow machine; what took a square of the nodes would need far more
    assert got["stage"] == stage


def test_odd_values_fail_no_page():
    got = documents.document(START + f"<ol start='²'><li>x</ol><ol start={'9' * 5000}><li>y</ol><ol start=7><li>z</ol>")
    assert got["cause"] is None and got["markdown"].endswith("1. x\n\n1. y\n\n7. z")


def test_what_no_stage_foresees_is_a_row(monkeypatch):
    def broken(node):
        raise RecursionError

    monkeypatch.setattr(documents.md, "to_markdown", broken)
    got = documents.document(START)
    assert (got["stage"], got["cause"], got["markdown"]) == ("convert", "conversion failed", None) and got["content_html"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a<b", "a"),
        ("<p title=it's>x", '<p title="it&#x27;s">x</p>'),
        ("<p don't>x</p>", "<p don't=\"\">x</p>"),
        ("a < b <3 c", "a &lt; b &lt;3 c"),
        ("x</>y</ z>w", "xy<!-- z-->w"),
        ("<script>a</script x>b", "<script>a</script>b"),
        ("<!-->x<!--->y<!--z--!>", "<!---->x<!---->y<!--z-->"),
        ("<pre>\na</pre>", "<pre>a</pre>"),
    ],
)
def test_tokens(html, want):
    assert serialize(body("<body>" + html)) == f"<body>{want}</body>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p><b>x<br><p>y</p><p>z", "<p><b>x<br></b></p><p><b>y</b></p><p><b>z</b></p>"),
        ("<div><b>a</div>b", "<div><b>a</b></div><b>b</b>"),
        ("<a href=1>x<a href=2>y</a>z", '<a href="1">x</a><a href="2">y</a>z'),
        ("<a>1<div>2<a>3</a>4</div>5", "<a>1</a><div><a>2</a><a>3</a>4</div>5"),
        ("<span><div>x</span>y</div>z", "<span><div>xy</div>z</span>"),
        ("<p><b><b><b><b><p>x", "<p><b><b><b><b></b></b></b></b></p><p><b><b><b>x</b></b></b></p>"),
        ("<b><em><x><x><x><x><aside></b></em>", "<b><em><x><x><x><x></x></x></x></x></em></b><aside><b></b></aside>"),
        ("<table><b><tr><td>a</td></tr>b</table>c", "<b></b><b>b</b><table><tbody><tr><td>a</td></tr></tbody></table><b>c</b>"),
        ("<table>x<tr><td>1<td>2<tr><th>3</table>y", "x<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody></table>y"),
        ("<table><tr><td><b>x</td><td>y</table>z", "<table><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z"),
        ("<table><table>x", "<table></table>x<table></table>"),
        ("<td>x</td><tr>y", "xy"),
        ("<ul><li>a<div><li>b</ul>", "<ul><li>a<div></div></li><li>b</li></ul>"),
        ("<p>a<table><tr><td>b<p>c</table>d", "<p>a<table><tbody><tr><td>b<p>c</p></td></tr></tbody></table>d</p>"),
    ],
)
def test_misnested_formatting_and_loose_table_content(html, want):
    assert serialize(body("<body>" + html)) == f"<body>{want}</body>"


def test_doctype_lets_a_table_end_a_paragraph():
    assert serialize(body("<!DOCTYPE html><p>a<table></table>")) == "<body><p>a</p><table></table></body>"


def test_formatting_that_never_ends_stays_bounded():
    html = START + "".join(f"<p><b id={k}>x" for k in range(3000))
    began = time.process_time()
    got = documents.document(html)
    assert got["cause"] is None and time.process_time() - began < 12
    assert markdown.to_markdown(body("<b><b>x <i>y</i></b></b>")) == "**x *y***"
