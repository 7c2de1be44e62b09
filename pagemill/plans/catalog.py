"""Named queries over the tables of a folder. catalog_sql.py has their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, urls
from ..operators import assets, events, robots
from ..sources import responses, sinks
from ..sources.tables import stored
from . import crawl, documents

#: Robots files of the robots query; which one a site has, and with what status, follows from the length of its name.
ROBOTS_TXT = b"User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*.html$\nDisallow: /fr\nAllow: /fr/\nDisallow: /es/2\nCrawl-delay: 2.5\n"
FOR_US = b"User-agent: *\nDisallow: /\n\nUser-agent: PageMill # ours\nuser-agent: other\nDisallow: /es\nDisallow: /*/2\nAllow: /es/\n"
FOR_OTHERS = b"User-agent: somebody-else\nDisallow: /\n"
#: References and what they resolve to after the site.
REFERENCES = (
    ("/a/b", "/a/b"), ("page.html", "/page.html"), ("../x", "/x"), ("./y/", "/y/"), ("/a/./b/../c", "/a/c"), ("?q=1", "?q=1"), ("#top", "#top"), ("", ""),
    ("/a/..", "/"), ("/..", "/"), ("a/b/../../../c?d#e", "/c?d#e"), ("/a/b/.", "/a/b/"), ("/.hidden/..x", "/.hidden/..x"), ("/q?x=/../y", "/q?x=/../y"),
)
#: (tag, raw, kind) of links and images.
KINDS = (("a", "/x", "navigation"), ("a", "#x", "anchor"), ("img", "#x", "image"), ("img", "/i.png", "image"), ("a", "", "navigation"))
#: Markdown that breaks one rule each, and which.
DRAFTS = (
    ("# T\n\ntext", None), ("", "empty markdown content"), ("## T\n\ntext", "broken H1 invariant"), ("# T\n\nx\n\n# U\n\ny", "broken H1 invariant"),
    ("text\n\n# T\n\nx", "orphan content outside root hierarchy"), ("# T\n\nx\n\n### U\n\ny", "skipped heading levels"), ("```\n# no\n```\n\n# T\n\nx", None), ("- i\n\n# T", "orphan content outside root hierarchy"),
)
_ANCHOR = r'<a [^>]*href="([^"]*)"'


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.canonical("url").alias("canonical_url"))


def url_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_canonicalize(spark, sf_dir).groupBy("canonical_url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


def url_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on the host that sorts first: a table of one row decides, so it is broadcast."""
    p = _pages(spark, sf_dir).select("page_id", "url")
    first = p.agg(F.min(urls.host("url")).alias("wanted"))
    return p.join(F.broadcast(first), urls.same_host("url", "wanted")).select("page_id", urls.host("url").alias("host"))


def url_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.section("url").alias("section"))


def doc_id_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = urls.canonical("url")
    return _pages(spark, sf_dir).select("page_id", hashing.address(c).alias("doc_id"), hashing.file_name(c).alias("file"))


def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the raw page, by pattern; the links of the main content come from extract_main."""
    found = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))
    return _pages(spark, sf_dir).select("page_id", "url", F.posexplode(found).alias("ord", "raw")).select("page_id", "url", "ord", F.regexp_replace("raw", "&amp;", "&").alias("raw"))


def links_kind_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_extract(spark, sf_dir).groupBy(urls.link_kind(F.lit("a"), "raw").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _resolved() -> Column:
    return urls.resolve_on("raw", "url")


def links_resolve_same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = links_extract(spark, sf_dir).withColumn("resolved", _resolved())
    return each.filter(urls.same_host("resolved", urls.host("url"))).select("page_id", "ord", "resolved")


def link_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = links_extract(spark, sf_dir).select("page_id", urls.canonical(_resolved()).alias("target"))
    return each.groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every sort against every page's site."""
    raw = F.array(*[F.lit(r) for r, _ in REFERENCES])
    return _pages(spark, sf_dir).select("page_id", "url", F.posexplode(raw).alias("ord", "raw")).select("page_id", "ord", urls.resolve_on("raw", "url").alias("resolved"))


def url_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.truncated("url", 30).alias("shown"))


def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(r).alias("raw")) for t, r, _ in KINDS])
    return _pages(spark, sf_dir).select("page_id", F.posexplode(refs).alias("ord", "ref")).select("page_id", "ord", urls.link_kind("ref.tag", "ref.raw").alias("kind"))


def robots_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with rules for everyone, for this agent, for others only, with no file, and with one that can't be had."""
    p = _pages(spark, sf_dir).select("page_id", urls.canonical("url").alias("url"))
    which = F.length("site") % 5
    body = F.when(which == 0, F.lit(ROBOTS_TXT)).when(which == 1, F.lit(FOR_US)).when(which == 2, F.lit(FOR_OTHERS))
    status = F.when(which == 3, 404).when(which == 4, 503).otherwise(200)
    files = p.select(robots.site("url").alias("site")).distinct().select("site", status.alias("status"), body.alias("body"))
    return robots.decide(p, robots.rules(files, "PageMill/1.0")).select("page_id", "allowed", "reason", "crawl_delay_ms")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.measured(_pages(spark, sf_dir)).select("page_id", *[f"n_{t}" for t in ("p", "a", "li", "h1", "h2", "code", "div")])


def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the page's body as a container."""
    return documents.measured(_pages(spark, sf_dir)).select("page_id", "solid", "paragraphs", "headings", F.round("score", 4).alias("score"))


def link_density_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which links make at most a hundredth of the text."""
    return documents.measured(_pages(spark, sf_dir)).select("page_id", "link_bytes", "text_bytes").filter(F.col("link_bytes") * 100 <= F.col("text_bytes"))


def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parsed(_pages(spark, sf_dir), columns=("title",)).select("page_id", "title")


def draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft a page, by page_id, and the rule that it breaks."""
    draft = F.element_at(F.array(*[F.lit(t) for t, _ in DRAFTS]), (F.col("page_id") % len(DRAFTS) + 1).cast("int"))
    return _pages(spark, sf_dir).select("page_id", documents.broken_rule(draft).alias("cause"))


def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images a page, shared between pages, some missing and some of equal content, resolved in the page's Markdown."""
    n = F.col("page_id").cast("string")
    one = F.concat(F.lit("/img/a b"), (F.col("page_id") % 40).cast("string"), F.lit(".png?v="), n)
    two = F.concat(F.lit("https://cdn.example.com/i/"), (F.col("page_id") % 30).cast("string"), F.lit(".gif"))
    docs = _pages(spark, sf_dir).select(F.col("page_id").alias("page_rank"), "url", one.alias("one"), two.alias("two"))
    docs = docs.withColumn("markdown", F.concat(F.lit("x ![one]("), "one", F.lit(") y ![two]("), "two", F.lit(") z ![one]("), "one", F.lit(")")))
    docs = docs.withColumn("refs", F.transform(F.array("one", "two", "one"), lambda r: F.struct(r.alias("raw"), F.lit("image").alias("kind"))))
    each = assets.images(docs).select("resolved").distinct().withColumn("k", F.regexp_extract("resolved", "([0-9]+)[.](png|gif)", 1).cast("int"))
    status = F.when(F.col("k") % 7 == 0, 404).when(F.col("k") % 7 == 1, 503).otherwise(200)
    fetched = each.select(F.col("resolved").alias("url"), status.alias("status"), F.concat(F.lit("bytes"), (F.col("k") % 10).cast("string")).cast("binary").alias("bytes"))
    done = assets.resolve(docs, fetched)
    missing = F.array_join(F.array_sort(F.transform(F.map_entries("missing"), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))), "|")
    return done.select(F.col("page_rank").alias("page_id"), "markdown", F.array_join("local", "|").alias("local"), missing.alias("missing"))


def asset_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = urls.canonical("url")
    return _pages(spark, sf_dir).select("page_id", assets.asset_path(c, hashing.digest(c)).alias("path"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", hashing.address("text").alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made up from page_id, with the class of their failure."""
    status = F.element_at(F.array(*map(F.lit, (200, 301, 403, 404, 429, 500, 503, None))), (F.col("page_id") % 8 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    p = _pages(spark, sf_dir).select("page_id", "url", status.alias("status"), kind.alias("content_type"))
    return p.withColumn("stage", F.lit("fetch")).withColumn("cause", events.fetch_cause(F.col("status"), F.col("content_type")))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _responses(spark, sf_dir).withColumn("seq", F.col("page_id"))
    attrs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("url", F.col("url")), ("status", F.col("status").cast("string")), ("url", F.lit("later")))])
    errors = r.filter("cause is not null").withColumn("package", F.col("stage")).withColumn("attrs", attrs)
    skips = r.filter("page_id % 11 = 0").withColumn("reason", F.lit("robots_disallow"))
    done = r.filter("cause is null").select("seq", F.col("stage"), F.col("url").alias("page_url"), F.lit(True).alias("success"), F.lit(3).alias("links_found"))
    return events.event_log(fetch=r.withColumn("retry_count", F.col("page_id") % 3), error=errors, skip=skips, pipeline=done)


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of a crawl of all pages, one row."""
    r = _responses(spark, sf_dir)
    return events.stats(r, r.count(), assets=7)


def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("about", F.coalesce("fetch.url", "pipeline.page_url", "skip.url", events.attribute("error.attrs", "url")))
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("about").alias("n_urls"), F.sum("fetch.retry_count").alias("retries"), F.max("seq").alias("last_seq"))


def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return log.rollup("kind", F.col("error.cause").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person has to look at, as rows of the retry journal."""
    r = _responses(spark, sf_dir).filter("cause is not null").withColumn("retry_count", F.col("page_id") % 3).withColumn("ts", F.lit(None).cast("timestamp"))
    return events.to_journal(r).select("url", "stage", "error", "retry_count")


def retry_backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waits before all retries of every page, with jitter drawn from its id."""
    each = _pages(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("attempt"))
    key = F.concat_ws("-", F.col("page_id").cast("string"), F.col("attempt").cast("string"))
    return each.withColumn("wait_ms", events.backoff_ms(F.col("attempt"), jitter=events.jitter_ms(key, 500)))


def politeness_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", urls.host("url").alias("host"), F.col("page_id").alias("rank"), F.when(F.col("page_id") % 3 == 0, 2500).alias("crawl_delay_ms"))
    return events.politeness(p, jitter=events.jitter_ms(F.col("page_id"), 500), refused=F.col("page_id") % 4 > 1).select("page_id", "host", "wait_ms", "start_ms")


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed response, and one known failure of any stage a page, with their classes."""
    known = F.array(*[F.struct(F.lit(row[0]).alias("stage"), F.lit(row[1]).alias("cause")) for row in events.CLASSES])
    other = _pages(spark, sf_dir).withColumn("x", F.element_at(known, (F.col("page_id") % len(events.CLASSES) + 1).cast("int"))).select("page_id", "x.stage", "x.cause")
    p = _responses(spark, sf_dir).filter("cause is not null").select("page_id", "stage", "cause").unionByName(other)
    return events.classified(p).select("page_id", "stage", "cause", "policy", "canonical_cause", "impact")


def _nation_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' graph: region r leads to its nations, nation n to the regions n % 5 and n % 3."""
    n = _table(spark, sf_dir, "nation")
    u = lambda kind, key: F.concat(F.lit(f"https://h/{kind}/"), F.col(key).cast("string"))
    down = n.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("/n/"), k.cast("string"))).alias("links")).select(u("r", "n_regionkey").alias("url"), "links")
    up = n.select(u("n", "n_nationkey").alias("url"), F.array(F.concat(F.lit("/r/"), (F.col("n_nationkey") % 5).cast("string")), F.concat(F.lit("/r/"), (F.col("n_nationkey") % 3).cast("string"))).alias("links"))
    return down.unionByName(up)


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the nations' graph from region 0."""
    admitted, _ = crawl.crawl(_nation_web(spark, sf_dir), "https://h/r/0", crawl.CrawlParams(max_depth=4, max_pages=0))
    return admitted.select("url", "depth")


def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight pages of the nations' graph in the order of the queue, with a robots file that keeps region 1 out."""
    files = spark.createDataFrame([("https://h", 200, bytearray(b"User-agent: *\nDisallow: /r/1\n"))], "site string, status int, body binary")
    admitted, _ = crawl.crawl(_nation_web(spark, sf_dir), "https://H/r/0/", crawl.CrawlParams(max_depth=3, max_pages=8), robots.rules(files, "pagemill"))
    # at most max_pages rows
    return admitted.select("url", "depth", F.row_number().over(Window.orderBy("depth", "rank")).alias("place"))


# ------------------------------------------------- the document map


def extract_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parsed(_pages(spark, sf_dir), columns=("layer", "selector", "content_html", "cause")).select("page_id", "layer", "selector", F.length("content_html").cast("long").alias("n_chars"), "cause")


def sanitize_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parsed(_pages(spark, sf_dir), columns=("content_html", "links")).select("page_id", "content_html", F.array_join("links", "|").alias("links"))


def to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parsed(_pages(spark, sf_dir), columns=("markdown", "refs")).select("page_id", "markdown", F.array_join("refs.raw", "|").alias("refs"))


def normalize_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.documents(_pages(spark, sf_dir)).select("page_id", "title", "section", "doc_id", "content_hash", "stage", "cause")


def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with images resolved (dry run) and their document records."""
    kept = ("markdown", "refs", "title", "stage", "cause")
    d = stored(documents.parsed(_pages(spark, sf_dir), columns=kept).withColumn("page_rank", F.col("page_id")))  # parsed once
    done = assets.resolve(d, None)
    return documents.with_frontmatter(done).select("page_id", "canonical_url", "title", "section", "doc_id", "content_hash", "file", "stage", "cause", F.array_join("local", "|").alias("local"))


def markdown_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Markdown sink would write, dry."""
    return sinks.write_markdown(documents.documents(_pages(spark, sf_dir))).select("url_hash", "path", "content_hash", "cause")


def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five attempts a page, with answers that follow from page_id, and the one that counts of at most four."""
    status = F.element_at(F.array(*map(F.lit, (503, 429, None, 200, 403, 200, 500))), ((F.col("page_id") * 3 + F.col("attempt") * (F.col("page_id") % 4 + 1)) % 7 + 1).cast("int"))
    each = _pages(spark, sf_dir).select("page_id", "url", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    attempts = each.select(F.concat_ws(" ", "page_id", "url").alias("url"), "attempt", status.alias("status"), F.lit("text/html").alias("content_type"), F.lit(b"x").alias("body"))
    return responses.settled(attempts, max_attempt=4).select("url", "status", "tries", "wait_ms", "cause")


def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By depth, how many pages of the nations' graph were admitted and how many still wait when the regions are done."""
    admitted, _ = crawl.crawl(_nation_web(spark, sf_dir), "https://h/r/0", crawl.CrawlParams(max_depth=4, max_pages=0))
    return crawl.progress(admitted, admitted.filter(F.col("url").contains("/r/")))


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole site of the first page, at any depth, over whole-page links."""
    p = _pages(spark, sf_dir)
    seed = p.agg(F.min(F.struct("page_id", "url")).alias("x")).first()["x"]["url"]
    links = p.select("url", F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("links"))
    admitted, _ = crawl.crawl(links, seed, crawl.CrawlParams(max_depth=0, max_pages=0))
    return admitted.select("url", "depth")


QUERIES = (
    url_canonicalize, url_dedup_first, url_host_filter, url_section, url_resolve, url_display, doc_id_sha256, links_extract, links_kind_count, link_kinds, links_resolve_same_host, link_graph_degree, robots_decide,
    tag_counts, content_score, link_density_filter, title_extract, draft_checks, image_rewrite, asset_path, content_dedup, event_stats, event_kinds, event_rollup, journal_rows, retry_backoff_schedule,
    politeness_schedule, error_classify, bfs_levels, crawl_order, extract_main, sanitize_doc, to_markdown, normalize_doc, pipeline_full, markdown_manifest, fetch_retries, crawl_progress, crawl_bfs,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
