"""Answers to requests, as tables: what is asked for, which answers are pages, and which of several attempts counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import events

#: What is preferred of each kind, with its weight below one.
_PREFERRED = {
    "page": {"text/html": None, "application/xhtml+xml": None, "application/xml": 9, "*/*": 8},
    "asset": {f"image/{x}": None for x in ("webp", "apng", "*")} | {"*/*": 8},
}


def _weighed(kinds: dict[str, int | None]) -> str:
    return ",".join(kind if tenths is None else f"{kind};q=0.{tenths}" for kind, tenths in kinds.items())


def request_headers(agent: str, kind: str = "page") -> dict[str, str]:
    """The headers that a request for a page or an asset carries."""
    fixed = {"Connection": "keep-alive", "DNT": "1", "Accept-Language": _weighed({"en-US": None, "en": 5})}
    return fixed | {"Accept": _weighed(_PREFERRED[kind]), "User-Agent": agent}


def settled(attempts: DataFrame, max_attempt: int = 10, content_type: bool = True, jitter: Column | None = None) -> DataFrame:
    """The attempt that counts for each url of (url, attempt, status, content_type, body): (url, status, content_type, body, tries, wait_ms, cause).

    Attempts count from 1 up to the first that succeeds, fails for good or is the last allowed; wait_ms is all that was waited
    between them, growing with each. ``content_type`` False takes any kind of answer, as for assets.
    """
    kind = F.col("content_type") if content_type else F.lit("text/html")
    marked = attempts.withColumn("cause", events.fetch_cause(F.col("status"), kind)).withColumn("stage", F.lit("fetch"))
    again = events.classified(marked).withColumn("again", F.col("cause").isNotNull() & (F.col("policy") == events.AUTO) & (F.col("attempt") < max_attempt))
    earlier = Window.partitionBy("url").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    live = again.withColumn("_open", F.coalesce(F.min("again").over(earlier), F.lit(True))).filter("_open")
    wait = F.when(F.col("attempt") > 1, events.backoff_ms(F.col("attempt") - 1, jitter=jitter)).otherwise(0)
    last = F.max_by(F.struct("status", "content_type", "body", "cause", "attempt"), "attempt").alias("x")
    found = live.groupBy("url").agg(last, F.sum(wait).alias("wait_ms"))
    return found.select("url", "x.status", "x.content_type", "x.body", F.col("x.attempt").cast("int").alias("tries"), "wait_ms", "x.cause")


def pages(settled_: DataFrame) -> DataFrame:
    """(url, html) of the answers that are pages; bytes that aren't UTF-8 are replaced."""
    return settled_.filter("cause is null").select("url", F.decode(F.col("body").cast("binary"), "UTF-8").alias("html"))
