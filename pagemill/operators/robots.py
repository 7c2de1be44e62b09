"""Robots rules: files are parsed once a site in an Arrow map, decisions for URLs are Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

BODY_BYTES = 500 << 10
ALLOWED, DISALLOWED, NO_AGENT, NO_RULES, NO_MATCH = "allowed_by_robots", "disallowed_by_robots", "user_agent_not_matched", "empty_rule_set", "no_matching_rules"
TOO_MANY, REDIRECTS, SERVER_ERROR, UNEXPECTED = "too many requests", "too many redirects", "http server error", "unexpected http status"


@dataclass
class Group:
    user_agents: list[str] = field(default_factory=list)
    allows: list[str] = field(default_factory=list)
    disallows: list[str] = field(default_factory=list)
    crawl_delay_ms: int | None = None


@dataclass
class Robots:
    sitemaps: list[str] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)


def parse(body: str) -> Robots:
    """Groups of a robots file. Neighbouring user-agent lines share one; rules before any of them are for everyone."""
    out, everyone, now, in_agents = Robots(), Group(["*"]), None, False
    for line in body.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not in_agents:
                now = Group()
                out.groups.append(now)
            now.user_agents.append(value)
            in_agents = True
        elif name in ("allow", "disallow"):
            in_agents = False
            (getattr(everyone if now is None else now, name + "s")).append(value)
        elif name == "crawl-delay":
            in_agents = False
            try:
                seconds = float(value)
            except ValueError:
                continue
            if now is not None and 0 <= seconds < 1e9:
                now.crawl_delay_ms = int(seconds * 1000)
        elif name == "sitemap" and value:
            out.sitemaps.append(value)
    if everyone.allows or everyone.disallows:
        out.groups.insert(0, everyone)
    return out


def group_for(groups: list[Group], agent: str, merge: bool = False) -> Group | None:
    """The first group that names the agent; else that of the longest name it begins with; else the first for everyone. ``merge`` joins groups of the same name."""
    agent = agent.lower()
    best, size, name = None, -1, None
    for g in groups:
        for a in g.user_agents:
            own = a.lower()
            if own == agent:
                rank = len(own) + 1
            elif own == "*":
                rank = 0
            elif own and agent.startswith(own):
                rank = len(own)
            else:
                continue
            if rank > size:
                best, size, name = g, rank, own
    if merge and best is not None:
        same = [g for g in groups if any(a.lower() == name for a in g.user_agents)]
        delays = [g.crawl_delay_ms for g in same if g.crawl_delay_ms is not None]
        return Group(best.user_agents, [p for g in same for p in g.allows], [p for g in same for p in g.disallows], delays[0] if delays else None)
    return best


RULE = "struct<allow:boolean,base:string,wild:boolean,ends:boolean,regex:string,size:int>"


def rule(path: str, allow: bool) -> dict | None:
    """A path pattern made ready: ``$`` at its end asks for the whole path, ``*`` stands for anything."""
    if not path:
        return None
    if not path.startswith(("/", "*")):
        path = "/" + path
    elif path.startswith("*"):
        path = "/" + path
    ends = path.endswith("$")
    base = path[:-1] if ends else path
    wild = "*" in base
    quoted = ".*".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" if p else "" for p in base.split("*"))
    size = len((base if ends else base.replace("*", "")).encode())
    return {"allow": allow, "base": base, "wild": wild, "ends": ends, "regex": f"(?s)^{quoted}" + ("" if base.endswith("*") else "$"), "size": size}


def rules(robots: DataFrame, agent: str, merge_same_agent: bool = False) -> DataFrame:
    """(site, rules, grouped, matched, crawl_delay_ms, sitemaps, cause) of robots files (site, status, body), a row a site.

    A missing file (4xx, but for 429) allows all; cause is set where the site's rules can't be known. Of several
    rows of a site the one with the smallest status and body counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for site, status, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ok = status is not None and 200 <= status < 300
                cause = None if ok else UNEXPECTED if status is None else TOO_MANY if status == 429 else REDIRECTS if 300 <= status < 400 else SERVER_ERROR if status >= 500 else None if status >= 400 else UNEXPECTED
                found = parse((body or b"").decode("utf-8", "replace")) if ok else Robots()
                g = group_for(found.groups, agent, merge_same_agent)
                own = [r for allow, paths in ((True, g.allows), (False, g.disallows)) for p in paths if (r := rule(p, allow))] if g else []
                rows.append({"site": site, "rules": own, "grouped": bool(found.groups), "matched": g is not None, "crawl_delay_ms": g.crawl_delay_ms if g else None, "sitemaps": found.sitemaps, "cause": cause})
            yield pa.RecordBatch.from_pylist(rows, schema)

    parts = [("allow", pa.bool_()), ("base", pa.string()), ("wild", pa.bool_()), ("ends", pa.bool_()), ("regex", pa.string()), ("size", pa.int32())]
    schema = pa.schema([("site", pa.string()), ("rules", pa.list_(pa.struct(parts))), ("grouped", pa.bool_()), ("matched", pa.bool_()), ("crawl_delay_ms", pa.int64()), ("sitemaps", pa.list_(pa.string())), ("cause", pa.string())])
    raw = robots.select(F.col("site").cast("string").alias("site"), F.col("status").cast("int").alias("status"), F.substring(F.col("body").cast("binary"), 1, BODY_BYTES).alias("body"))
    once = raw.groupBy("site").agg(F.min(F.struct("status", "body")).alias("x")).select("site", "x.status", "x.body")
    return once.mapInArrow(run, f"site string, rules array<{RULE}>, grouped boolean, matched boolean, crawl_delay_ms long, sitemaps array<string>, cause string")


def site(url: Column | str) -> Column:
    """scheme://host:port, the key of a site's robots file."""
    return F.concat(urls.scheme(url), F.lit("://"), urls.lower_ascii(urls.authority(url)))


def _priority(path: Column, r: Column) -> Column:
    whole = ~r["wild"] & (path == r["base"])
    plain = F.startswith(path, r["base"])
    hit = F.when(r["wild"], F.rlike(path, r["regex"])).when(r["ends"], plain & F.endswith(path, r["base"])).otherwise(plain)
    value = r["size"] + F.when(r["ends"] | whole, 1000.0).otherwise(0.0) - F.when(r["allow"], 0.0).otherwise(0.5)
    return F.when(hit, F.struct(value.alias("priority"), r["allow"].alias("allow")))


def decide(found: DataFrame, ruled: DataFrame, url: str = "url") -> DataFrame:
    """``found`` with allowed, reason and crawl_delay_ms for the paths of its URLs. A site without a row allows all; one whose rules can't be known allows nothing, and the reason is its cause."""
    # a row a site: far fewer than URLs, but its size follows the input, so the join's kind is left to Spark
    sites = ruled.select(F.col("site").alias("_site"), F.col("rules").alias("_rules"), F.col("grouped").alias("_grouped"), F.col("matched").alias("_matched"), F.col("crawl_delay_ms"), F.col("cause").alias("_cause"))
    joined = found.withColumn("_site", site(url)).join(sites, "_site", "left")
    p = urls.path(url)
    path = F.when(p == "", "/").otherwise(p)
    joined = joined.withColumn("_best", F.array_max(F.transform("_rules", lambda r: _priority(path, r))))
    empty = F.coalesce(F.size("_rules"), F.lit(0)) <= 0
    allowed = F.when(F.col("_cause").isNotNull(), F.lit(False)).when(empty | F.col("_best").isNull(), F.lit(True)).otherwise(F.col("_best.allow"))
    lost = F.coalesce(F.col("_grouped"), F.lit(False)) & ~F.coalesce(F.col("_matched"), F.lit(False))
    reason = F.when(F.col("_cause").isNotNull(), F.col("_cause")).when(empty & lost, NO_AGENT).when(empty, NO_RULES)
    reason = reason.when(F.col("_best").isNull(), NO_MATCH).when(F.col("_best.allow"), ALLOWED).otherwise(DISALLOWED)
    return joined.withColumns({"allowed": allowed, "reason": reason}).drop("_site", "_rules", "_grouped", "_matched", "_cause", "_best")
