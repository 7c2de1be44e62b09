"""Pages to documents: extraction, repair, conversion and checks in one Arrow map, all else in the JVM.

HTML is parsed once. A page that fails keeps its row, with the stage and the cause, so that failures can be
routed and counted; nothing raises. Rows are independent of each other: the plan has no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import hashing, urls
from ..operators import markdown as md
from ..operators.dom import find, parse, serialize
from ..operators.extract import NOT_HTML, ExtractParams, count, extract, score
from ..operators.sanitize import UNPARSEABLE, sanitize

VERSION = "pagemill/0.1"
NO_SECTION = "section derivation failed"
_FIELDS = "layer int, selector string, content_html string, links array<string>, markdown string, refs array<struct<raw:string,kind:string>>, title string, stage string, cause string"
_REFS = pa.list_(pa.struct([("raw", pa.string()), ("kind", pa.string())]))
_KINDS = {"layer": pa.int32(), "links": pa.list_(pa.string()), "refs": _REFS}
NAMES = [x.strip().split(" ")[0] for x in ("layer, selector, content_html, links, markdown, refs, title, stage, cause").split(",")]


def document(html: str | None, params: ExtractParams = ExtractParams(), strict_empty_sections: bool = False) -> dict:
    """All that one page yields. ``stage`` and ``cause`` are null for a sound document, else name its first failure.

    What no stage foresees is a failure of the stage that it arose in, never an exception of the job.
    """
    out: dict = dict.fromkeys(NAMES)
    if html is None:
        return out | {"stage": "fetch", "cause": "failed to read response body"}
    stage, cause = "extract", NOT_HTML
    try:
        found = extract(html, params)
        if found.node is None:
            return out | {"stage": "extract", "cause": found.cause}
        out |= {"layer": found.layer, "selector": found.selector}
        stage, cause = "sanitize", UNPARSEABLE
        clean = sanitize(found.node)
        if clean.node is None:
            return out | {"stage": "sanitize", "cause": clean.cause}
        out |= {"content_html": serialize(clean.node), "links": clean.links}
        stage, cause = "convert", md.FAILED
        text = md.to_markdown(clean.node)
        out |= {"markdown": text, "refs": [{"raw": r, "kind": k} for r, k in md.link_refs(clean.node)]}
        stage, cause = "normalize", md.NO_TITLE
        out["title"] = md.title(text)
        broken = md.check(text, strict_empty_sections) or (md.NO_TITLE if out["title"] is None else None)
        return out | ({"stage": "normalize", "cause": broken} if broken else {})
    except (ArithmeticError, AttributeError, LookupError, RuntimeError, TypeError, ValueError):
        return out | {"stage": stage, "cause": cause}


def parsed(pages: DataFrame, params: ExtractParams = ExtractParams(), strict_empty_sections: bool = False, columns: tuple[str, ...] = tuple(NAMES)) -> DataFrame:
    """(page_id, url, layer, selector, content_html, links, markdown, refs, title, stage, cause) of every page; of these ``columns`` only what is asked for leaves Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [document(html, params, strict_empty_sections) for html in part.column(2).to_pylist()]
                made = [pa.array([r[n] for r in rows], _KINDS.get(n, pa.string())) for n in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["page_id", "url", *columns])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kinds = dict(x.split(" ", 1) for x in _FIELDS.split(", "))
    return narrow.mapInArrow(run, ", ".join(["page_id long", "url string", *(f"{n} {kinds[n]}" for n in columns)]))


def measured(pages: DataFrame, params: ExtractParams = ExtractParams(), tags: tuple[str, ...] = ("p", "a", "li", "h1", "h2", "code", "div")) -> DataFrame:
    """(page_id, text_bytes, solid, paragraphs, headings, links, link_bytes, score of the body element; n_<tag> of the whole tree) of every page; of a null html null."""
    names = ["text_bytes", "solid", "paragraphs", "headings", "links", "link_bytes"]

    def row(html: str | None) -> list:
        if html is None:
            return [None] * (len(names) + 1 + len(tags))
        tree = parse(html)
        seen = Counter(n.name for n in tree.elements())
        c = count(find(tree, "body"))
        return [*(getattr(c, n) for n in names), score(c, params), *(seen[t] for t in tags)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                columns = list(zip(*map(row, part.column(1).to_pylist()), strict=True))
                made = [pa.array(c, pa.float64() if k == len(names) else pa.int64()) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["page_id", *names, "score", *(f"n_{t}" for t in tags)])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, ", ".join(["page_id long", *(f"{n} long" for n in names), "score double", *(f"n_{t} long" for t in tags)]))


@F.pandas_udf(StringType())
def broken_rule(markdown: pd.Series) -> pd.Series:
    """The first rule of a document's structure that Markdown breaks, or null."""
    return markdown.map(lambda x: None if x is None else md.check(x))


def with_frontmatter(docs: DataFrame, prefixes: tuple[str, ...] = ("/",), algorithm: str = "sha256", version: str = VERSION) -> DataFrame:
    """``docs`` with the fields of a document record: canonical_url, section, doc_id, content_hash, file, crawler_version.

    ``crawl_depth`` and ``fetched_at`` are taken along where they are there, else null.
    """
    made = docs.withColumn("canonical_url", urls.canonical("url"))
    made = made.withColumn("section", urls.section("url", prefixes))
    lost = F.col("cause").isNull() & F.col("section").isNull()
    made = made.withColumn("stage", F.when(lost, "normalize").otherwise(F.col("stage"))).withColumn("cause", F.when(lost, NO_SECTION).otherwise(F.col("cause")))
    sound = F.col("cause").isNull()
    for name, kind in (("crawl_depth", "int"), ("fetched_at", "timestamp")):
        if name not in made.columns:
            made = made.withColumn(name, F.lit(None).cast(kind))
    return made.select(
        "*",
        F.when(sound, hashing.address("canonical_url", algorithm)).alias("doc_id"),
        F.when(sound, hashing.address("markdown", algorithm)).alias("content_hash"),
        F.when(sound, hashing.file_name("canonical_url", algorithm)).alias("file"),
        F.lit(version).alias("crawler_version"),
    )


def documents(pages: DataFrame, params: ExtractParams = ExtractParams(), prefixes: tuple[str, ...] = ("/",), algorithm: str = "sha256", strict_empty_sections: bool = False) -> DataFrame:
    """Every page with its document record, or the stage and cause of its failure."""
    return with_frontmatter(parsed(pages, params, strict_empty_sections), prefixes, algorithm)


def sound(docs: DataFrame) -> DataFrame:
    return docs.filter("cause is null")


def failed(docs: DataFrame) -> DataFrame:
    return docs.filter("cause is not null").select("page_id", "url", "stage", "cause")
