"""Settings, sinks, attempts, the event stream and its printer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagemill import config
from pagemill.operators import assets, events, printing
from pagemill.plans import crawl, documents
from pagemill.sources import responses, sinks, tables
from pagemill.streaming import event_log

LONG = "Enough words to make this paragraph count as meaningful content of a page. "

# ------------------------------------------------------------------ settings


@pytest.mark.parametrize(("text", "want"), [("2s", 2000), ("1m30s", 90_000), ("500ms", 500), ("1.5h", 5_400_000), ("0", 0), ("-1s", -1000), (".5s", 500)])
def test_durations(text, want):
    assert config.duration_ms(text) == want


@pytest.mark.parametrize("text", ["", "2", "s", "2 s", "2d", "1s2"])
def test_no_durations(text):
    with pytest.raises(config.BadConfig):
        config.duration_ms(text)


def test_settings_of_a_file(tmp_path):
    raw = {"seedUrls": ["https://a.org/docs", "http://u@b.org:8080/"], "allowedPathPrefix": ["/docs"], "maxDepth": 7, "baseDelay": "2s", "jitter": "1s", "dryRun": True, "scoreMultiplierParagraphs": 3, "selectorBlacklist": [".ad"], "unknown": 1}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(raw))
    got = config.load(str(path), max_pages=0)
    assert got.allowed_hosts == {"a.org", "b.org:8080"} and got.allowed_path_prefix == ("/docs",) and got.base_delay == 2000 and got.dry_run
    assert got.crawl_params() == crawl.CrawlParams(max_depth=7, max_pages=0)
    assert got.extract_params().per_paragraph == 3.0 and got.extract_params().blacklist == (".ad",) and got.hash_algo == "sha256"
    assert config.from_json('{"seedUrls": ["x"]}').allowed_path_prefix == () and config.Config().allowed_path_prefix == ("/",)
    assert config.from_json('{"seedUrls": ["https://a"], "allowedHosts": {"z": {}}}').built().allowed_hosts == {"z"}
    for bad in ("[]", "{", '{"maxDepth": "3"}', '{"baseDelay": 3}', '{"baseDelay": "x"}', '{"dryRun": 1}', '{"seedUrls": [1]}'):
        with pytest.raises(config.BadConfig):
            config.from_json(bad)
    for build in (lambda: config.from_json("{}").built(), lambda: config.load(str(tmp_path / "none")), lambda: config.Config(seed_urls=("https://a",), hash_algo="md5").built()):
        with pytest.raises(config.BadConfig):
            build()


# --------------------------------------------------------------------- sinks


def page(title):
    return f"<main><h1>{title}</h1><p>{LONG}</p></main>"


def test_markdown_files(spark, tmp_path):
    rows = [(1, "https://h/a", page("A")), (2, "https://h/a?x", page("B")), (3, "https://h/c", page("C")), (4, "https://h/d", None), (None, "https://h/a", page("Z"))]
    docs = documents.documents(spark.createDataFrame(rows, "page_id long, url string, html string"))
    dry = sinks.write_markdown(docs)
    for _ in range(2):  # again over the same files
        done = sinks.write_markdown(docs, str(tmp_path)).collect()
        assert sorted(f.name for f in tmp_path.iterdir()) == sorted(r.path for r in done)
    assert sorted(dry.drop("cause").collect()) == sorted((r.url_hash, r.path, r.content_hash) for r in done)
    by = {r.path: (tmp_path / r.path).read_text() for r in done}
    assert len(by) == 2 and sorted(t.split("\n")[0] for t in by.values()) == ["# C", "# Z"] and all(r.cause is None for r in done)
    assert sinks.write_markdown(docs.limit(0), str(tmp_path / "none")).collect() == []


def test_a_file_that_cannot_be_written_has_a_cause(spark, tmp_path):
    (tmp_path / "a").write_text("a file, no folder")
    files = spark.createDataFrame([("a/b.md", bytearray(b"x")), ("c/d.md", bytearray(b"y")), (None, bytearray(b"z")), ("e", None)], "path string, bytes binary")
    assert {r.path: r.cause for r in sinks.write_files(files, str(tmp_path)).collect()} == {"a/b.md": "write failed", "c/d.md": None}
    assert (tmp_path / "c/d.md").read_bytes() == b"y"


def test_assets_and_stages(spark, tmp_path):
    refs = [("/i.png", "image"), ("/j.png", "image"), ("/gone.png", "image")]
    docs = spark.createDataFrame([(1, "https://h/p", refs)], "page_rank long, url string, refs array<struct<raw:string,kind:string>>")
    fetched = spark.createDataFrame([("https://h/i.png", 200, bytearray(b"A")), ("https://h/j.png", 200, bytearray(b"A")), ("https://h/gone.png", 404, None)], "url string, status int, bytes binary")
    kept = assets.kept(assets.images(docs), fetched)
    (row,) = sinks.write_assets(kept, fetched, str(tmp_path)).collect()
    assert row.path.startswith("assets/images/i-") and (tmp_path / row.path).read_bytes() == b"A"
    stages = spark.createDataFrame([("https://h/p", "<p>x", None, "# m")], "url string, html string, content_html string, markdown string")
    names = {r.path.split("/", 1)[1] for r in sinks.dump_stages(stages, str(tmp_path / "d")).collect()}
    assert names == {"01_fetcher.html", "05_asset_resolver.md"}


def test_journal_is_counted_and_cleared(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = spark.createDataFrame([("u", "fetch", "forbidden", 1, None)], events.JOURNAL)
    assert events.count_journal(spark, path) == 0
    events.append_journal(rows, path)
    assert events.count_journal(spark, path) == 1
    events.clear_journal(spark, path)
    events.clear_journal(spark, path)
    assert events.count_journal(spark, path) == 0


# ------------------------------------------------------------------- answers


def test_headers():
    got = responses.request_headers("me")
    assert got["User-Agent"] == "me" and got["Accept"].startswith("text/html,") and got["Accept"].endswith("*/*;q=0.8") and got["Accept-Language"].endswith("en;q=0.5")
    assert responses.request_headers("me", "asset")["Accept"].startswith("image/")


def test_attempts(spark):
    rows = [("a", 1, 503, None), ("a", 2, None, None), ("a", 3, 200, "text/html"), ("a", 4, 500, None), ("b", 1, 403, None), ("b", 2, 200, "text/html"), ("c", 1, 500, None), ("c", 2, 500, None), ("c", 3, 500, None), ("d", 1, 200, "image/png")]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, content_type string").withColumn("body", F.lit(b"\xc3\xa9"))
    got = {r.url: (r.status, r.tries, r.wait_ms, r.cause) for r in responses.settled(df, 3).collect()}
    assert got == {"a": (200, 3, 300, None), "b": (403, 1, 0, "forbidden"), "c": (500, 3, 300, "5xx"), "d": (200, 1, 0, "non-HTML content")}
    assert [tuple(r) for r in responses.pages(responses.settled(df, 3)).collect()] == [("a", "é")]
    assert {r.url for r in responses.settled(df, 3, content_type=False).filter("cause is null").collect()} == {"a", "d"}


# -------------------------------------------------------------------- events


def test_stream_sees_every_event_once(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    log = lambda *urls: events.event_log(fetch=spark.createDataFrame([(u, k, 200) for k, u in enumerate(urls)], "url string, seq long, status int").withColumn("ts", F.lit("2024-01-01 00:00:30").cast("timestamp")))
    event_log.append(log("a", "b"), path)
    run = lambda: event_log.subscribe(spark, path, lambda df, _: seen.extend(r.fetch.url for r in df.collect()), str(tmp_path / "at"), available_now=True).awaitTermination()
    run()
    assert sorted(seen) == ["a", "b"]
    event_log.append(log("c"), path)
    run()
    assert sorted(seen) == ["a", "b", "c"] and event_log.snapshot(spark, path).count() == 3
    assert [(r.kind, r.n) for r in event_log.counts_by_window(event_log.snapshot(spark, path)).collect()] == [("fetch", 3)]


def test_printed_events(spark):
    one = lambda **k: spark.createDataFrame([tuple(k.values())], list(k))
    error = one(seq=4, package="extractor", action="Extract", message="no content").withColumn("attrs", F.array(F.struct(F.lit("page_url").alias("key"), F.lit("https://h/a").alias("value"))))
    log = events.event_log(
        fetch=one(seq=1, url="https://h/a", status=200, content_type="text/html", duration_ms=1500, depth=2).unionByName(one(seq=2, url="https://h/i.png", status=200, content_type="image/png", duration_ms=0, depth=2), True).withColumn("kind", F.when(F.col("seq") == 2, "asset").otherwise("page")),
        pipeline=one(seq=3, stage="sanitize", success=True, links_found=4), error=error, skip=one(seq=5, url="https://h/" + "x" * 80, reason="robots_disallow"),
    )
    got = list(printing.lines(log.orderBy("seq").collect()))
    assert got[0] == "[FETCH] https://h/a - 200 text/html (1.500s, depth=2)"
    assert got[1].startswith("├── [FETCH] https://h/i.png") and got[2] == "├── [sanitize] success (4 links)" and got[3] == "└── [ERROR] extractor.Extract - no content"
    assert got[4].startswith("[SKIP] https://h/xxx") and "... - robots_disallow" in got[4] and len(got) == 5


# -------------------------------------------------------------------- tables


def test_stored_tables_are_released(spark):
    since = tables.mark()
    kept = tables.stored(spark.range(3))
    path = tables.last_stored()
    gone = tables.stored(spark.range(4))
    lost = tables.last_stored()
    assert tables.stored_bytes(gone) > 0
    tables.release(spark, since, keep=(path,))
    assert kept.count() == 3 and tables.mark() == since + 1
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(lost).count()
    tables.release(spark, since)


def test_progress(spark):
    admitted = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "url string, depth int")
    got = {r.depth: (r.admitted, r.waiting) for r in crawl.progress(admitted, admitted.filter("url <> 'c'")).collect()}
    assert got == {0: (1, 0), 1: (2, 1)}
