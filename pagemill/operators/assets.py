"""Images of documents: resolved, fetched once, kept once by content, and put into the Markdown by local path."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import hashing, urls

TOO_LARGE, MISSING = "asset too large", "network issues"
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")


def _use(docs: DataFrame) -> Column:
    """Names a row by all that its images depend on: rows that agree in it get the same result."""
    return F.md5(F.to_json(F.struct(docs["page_rank"], docs["url"], docs["refs"])))


def images(docs: DataFrame) -> DataFrame:
    """(use, page_rank, ord, raw, resolved, key) of every image reference of docs (page_rank, url, refs) that has an address: one relative to a null url has none."""
    rows = docs.select(_use(docs).alias("use"), "page_rank", "url", "refs").dropDuplicates(["use"])
    each = rows.select("use", "page_rank", "url", F.posexplode(F.filter("refs", lambda r: (r["kind"] == "image") & r["raw"].isNotNull())).alias("ord", "ref"))
    each = each.select("use", "page_rank", "ord", F.col("ref.raw").alias("raw"), urls.resolve_on("ref.raw", "url").alias("resolved")).filter("resolved is not null")
    return each.withColumn("key", urls.canonical("resolved"))


def first_uses(used: DataFrame) -> DataFrame:
    """One row a key: the first use in crawl order, whose URL, query included, is the one to fetch."""
    first = F.min(F.struct(F.col("page_rank").isNull().alias("none"), "page_rank", "ord", "resolved")).alias("first")
    return used.groupBy("key").agg(first).select("key", "first.page_rank", "first.ord", "first.resolved")


def status_cause(status: Column) -> Column:
    s = status
    return F.when(s.isNull(), MISSING).when(s >= 500, "5xx").when(s == 429, "too many requests").when(s >= 400, "forbidden").when(s >= 300, "reached redirect limit")


def safe_name(path: Column | str) -> Column:
    """The last segment without its extension, unsafe characters replaced, of at most 100 bytes."""
    p = F.col(path) if isinstance(path, str) else path
    base = F.regexp_replace(F.regexp_extract(p, r"([^/]*)/*$", 1), r"\.[^.]*$", "")
    clean = F.regexp_replace(base, r'[/\\:*?"<>| ]', "_")
    # at most 100 bytes, in whole characters
    fits = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda n: F.when(F.octet_length(F.substring(clean, F.lit(1), n)) <= 100, n)))
    cut = F.when(F.octet_length(clean) <= 100, clean).otherwise(F.substring(clean, F.lit(1), fits))
    return F.when(cut == "", "asset").otherwise(cut)


def asset_path(url: Column | str, digest: Column | str) -> Column:
    """assets/images/<name>-<7 hex digits>.<extension>"""
    path = urls.path(url)
    ext = urls.extension(path)
    d = F.col(digest) if isinstance(digest, str) else digest
    return F.concat(F.lit("assets/images/"), safe_name(path), F.lit("-"), F.substring(d, 1, 7), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def kept(used: DataFrame, fetched: DataFrame | None, max_bytes: int = 0, algorithm: str = "sha256") -> DataFrame:
    """(key, resolved, cause, hash, path, new, size) of every key; equal contents share the path of the first in crawl order.

    ``fetched`` is (url, status, bytes); without it the run is dry and the URL's own hash stands for the content's.
    ``max_bytes`` 0 means no limit.
    """
    first = first_uses(used)
    if fetched is None:
        held = first.withColumns({"cause": F.lit(None).cast("string"), "hash": hashing.digest("resolved", algorithm), "size": F.lit(0).cast("long")})
    else:
        body = F.col("_a.bytes").cast("binary")
        once = fetched.groupBy(F.col("url").alias("resolved")).agg(F.min(F.struct("status", "bytes")).alias("_a"))
        large = (F.lit(max_bytes) > 0) & (F.octet_length(body) > max_bytes)
        cause = F.coalesce(status_cause(F.col("_a.status")), F.when(body.isNull(), "failed to read response body"), F.when(large, TOO_LARGE))
        held = first.join(once, "resolved", "left").withColumn("cause", cause)
        held = held.withColumn("hash", F.when(F.col("cause").isNull(), hashing.digest(body, algorithm))).withColumn("size", F.octet_length(body).cast("long")).drop("_a")
    w = Window.partitionBy("hash").orderBy(F.asc_nulls_last("page_rank"), "ord", "key")
    good = held.filter("cause is null").withColumn("path", F.first(asset_path("resolved", "hash")).over(w)).withColumn("new", F.row_number().over(w) == 1)
    bad = held.filter("cause is not null").withColumn("path", F.lit(None).cast("string")).withColumn("new", F.lit(False))
    return good.unionByName(bad).select("key", "resolved", "cause", "hash", "path", "new", "size")


def rewritten(markdown: str, paths: dict[str, str]) -> str:
    """Image addresses replaced where all between the parentheses is a known one."""
    return _IMAGE.sub(lambda m: f"![{m[1]}]({paths[m[2]]})" if m[2] in paths else m[0], markdown)


@F.pandas_udf(StringType())
def _rewrite(markdown: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else rewritten(m, dict(p)) if p is not None and len(p) else m for m, p in zip(markdown, paths, strict=True)], dtype=object)


def resolve(docs: DataFrame, fetched: DataFrame | None, max_bytes: int = 0, algorithm: str = "sha256") -> DataFrame:
    """docs (page_rank, url, markdown, refs, ...) with local image paths in the Markdown, and missing map<url,cause>, local array<string> (sorted).

    Every row has its own images, whether page_rank repeats or is null; a null url leaves relative images as they are, null
    refs are no images, and a null markdown stays null. Documents without images keep out of the joins' Python step: it
    sees only texts that change.
    """
    used = images(docs)
    held = kept(used, fetched, max_bytes, algorithm)
    own = used.join(held.select("key", "cause", "path"), "key")
    paths = F.collect_set(F.when(F.col("path").isNotNull(), F.struct("raw", "path")))
    lost = F.collect_set(F.when(F.col("cause").isNotNull(), F.struct("resolved", "cause")))
    per = own.groupBy(F.col("use").alias("_use")).agg(F.map_from_entries(paths).alias("_paths"), F.map_from_entries(lost).alias("missing"), F.sort_array(F.collect_set("path")).alias("local"))
    joined = docs.withColumn("_use", _use(docs)).join(per, "_use", "left")
    changed = joined.filter(F.size("local") > 0).withColumn("markdown", _rewrite("markdown", "_paths"))
    same = joined.filter(F.coalesce(F.size("local"), F.lit(0)) <= 0)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = changed.unionByName(same).drop("_paths", "_use")
    return both.withColumn("missing", F.coalesce("missing", none)).withColumn("local", F.coalesce("local", F.array().cast("array<string>")))
