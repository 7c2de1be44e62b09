"""The event log, failure classes, crawl statistics, retry and politeness schedules, and the retry journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import delete

AUTO, MANUAL, NEVER = "auto", "manual", "never"
NETWORK, POLICY, CONTENT, STORAGE, INVARIANT, UNKNOWN = "network_failure", "policy_disallow", "content_invalid", "storage_failure", "invariant_violation", "unknown"

#: (stage, cause, retry policy, canonical cause). No failure of one document ends a crawl: the impact is always "continue".
CLASSES = [
    *[("fetch", c, p, k) for c, p, k in [
        ("timeout", AUTO, NETWORK), ("network issues", AUTO, UNKNOWN), ("failed to read response body", AUTO, UNKNOWN), ("non-HTML content", MANUAL, UNKNOWN),
        ("reached redirect limit", NEVER, UNKNOWN), ("forbidden", MANUAL, UNKNOWN), ("too many requests", AUTO, POLICY), ("5xx", AUTO, UNKNOWN), ("repeated 403s", NEVER, POLICY)]],
    *[("asset", c, p, k) for c, p, k in [
        ("path error", NEVER, STORAGE), ("disk is full", MANUAL, STORAGE), ("write failed", NEVER, STORAGE), ("timeout", AUTO, NETWORK), ("too many requests", AUTO, POLICY),
        ("network issues", AUTO, UNKNOWN), ("repeated 403s", NEVER, POLICY), ("failed to read response body", AUTO, CONTENT), ("non-HTML content", NEVER, CONTENT), ("reached redirect limit", NEVER, UNKNOWN),
        ("forbidden", MANUAL, POLICY), ("5xx", AUTO, UNKNOWN), ("asset too large", NEVER, POLICY), ("hash error", NEVER, CONTENT)]],
    *[("storage", c, p, k) for c, p, k in [("disk is full", MANUAL, STORAGE), ("write failed", NEVER, STORAGE), ("path error", NEVER, STORAGE), ("hash computation failed", NEVER, INVARIANT)]],
    *[("robots", c, p, k) for c, p, k in [
        ("root disallowed to be crawled", NEVER, POLICY), ("invalid robots.txt URL", NEVER, INVARIANT), ("failed before making fetch", NEVER, UNKNOWN), ("failed to fetch", AUTO, NETWORK), ("too many requests", AUTO, NETWORK),
        ("too many redirects", NEVER, NETWORK), ("http server error", AUTO, NETWORK), ("unexpected http status", NEVER, NETWORK), ("failed to parse robots.txt", NEVER, CONTENT)]],
    *[("extract", c, NEVER, CONTENT if c == "no content" else UNKNOWN) for c in ("no content", "not an HTML content")],
    ("sanitize", "unparseable html", NEVER, CONTENT),
    *[("sanitize", c, NEVER, INVARIANT) for c in ("competing document roots", "no structural anchor", "multiple h1 without primary root", "implied multiple documents", "ambiguous dom structure")],
    ("convert", "conversion failed", NEVER, CONTENT),
    ("normalize", "empty markdown content", NEVER, CONTENT),
    *[("normalize", c, NEVER, INVARIANT) for c in (
        "broken H1 invariant", "section derivation failed", "title extraction failed", "hash computation failed", "frontmatter marshal failed",
        "skipped heading levels", "orphan content outside root hierarchy", "empty section", "broken atomic block")],
]


def classes(spark: SparkSession) -> DataFrame:
    """(stage, cause, policy, canonical_cause, impact): a fixed table of some fifty rows."""
    return spark.createDataFrame(CLASSES, "stage string, cause string, policy string, canonical_cause string").withColumn("impact", F.lit("continue"))


def classified(failures: DataFrame) -> DataFrame:
    """Failures (stage, cause, ...) with policy, canonical_cause and impact; unknown causes are never retried."""
    known = F.broadcast(classes(failures.sparkSession))  # fixed size
    joined = failures.join(known, ["stage", "cause"], "left")
    return joined.withColumn("policy", F.coalesce("policy", F.lit(NEVER))).withColumn("canonical_cause", F.coalesce("canonical_cause", F.lit(UNKNOWN))).withColumn("impact", F.coalesce("impact", F.lit("continue")))


def fetch_cause(status: Column, content_type: Column) -> Column:
    """Why a response isn't a page, or null."""
    html = F.lower(content_type).contains("text/html") | F.lower(content_type).contains("application/xhtml")
    s = status
    return F.when(s.isNull(), "network issues").when(s >= 500, "5xx").when(s == 429, "too many requests").when(s >= 400, "forbidden").when(s >= 300, "reached redirect limit").when(~F.coalesce(html, F.lit(False)), "non-HTML content")


# ------------------------------------------------------------------- schedules


def jitter_ms(key: Column, most_ms: int) -> Column:
    """From 0 to ``most_ms``, drawn from the key: another key, another wait, but the same one again when a task is repeated."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % (most_ms + 1)


def backoff_ms(attempt: Column, initial_ms: int = 100, factor: float = 2.0, cap_ms: int = 10_000, jitter: Column | None = None) -> Column:
    """Wait before the given retry (1 is the first); the jitter comes on top of it, within the cap."""
    wait = F.least(F.lit(float(cap_ms)), F.lit(float(initial_ms)) * F.pow(F.lit(factor), attempt - 1)).cast("long")
    return wait if jitter is None else F.least(F.lit(cap_ms).cast("long"), wait + jitter)


def politeness(urls_: DataFrame, base_ms: int = 1000, jitter: Column | None = None, refused: Column | None = None, initial_ms: int = 100, factor: float = 2.0, cap_ms: int = 10_000) -> DataFrame:
    """``urls_`` (host, rank, crawl_delay_ms, ...) with wait_ms and start_ms: hosts run side by side, each waiting between its own requests.

    Where ``refused`` (the host's robots file was answered with 429 or 5xx) holds for a row, the host backs off longer with each
    such row in succession; the first that isn't sets it back.
    """
    by = Window.partitionBy("host").orderBy("rank")
    wait = F.coalesce("crawl_delay_ms", F.lit(base_ms)).cast("long") + (F.lit(0) if jitter is None else jitter)
    rows = urls_
    if refused is not None:
        rows = rows.withColumn("_no", F.coalesce(refused, F.lit(False)))
        rows = rows.withColumn("_run", F.sum(F.when(F.col("_no"), 0).otherwise(1)).over(by))
        nth = F.sum(F.when(F.col("_no"), 1).otherwise(0)).over(Window.partitionBy("host", "_run").orderBy("rank"))
        wait = wait + F.when(F.col("_no"), backoff_ms(nth, initial_ms, factor, cap_ms)).otherwise(0)
    rows = rows.withColumn("wait_ms", wait.cast("long")).drop("_no", "_run")
    return rows.withColumn("start_ms", F.coalesce(F.sum("wait_ms").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


# ------------------------------------------------------------------- event log

KINDS = ("fetch", "artifact", "pipeline", "skip", "error", "stats")
EVENT = (
    "kind string, seq long, ts timestamp, fetch struct<url:string,status:int,duration_ms:long,content_type:string,retry_count:int,depth:int,kind:string>, "
    "artifact struct<kind:string,path:string,source_url:string,hash:string,overwrite:boolean,bytes:long>, pipeline struct<stage:string,page_url:string,success:boolean,links_found:int>, "
    "skip struct<url:string,reason:string>, error struct<package:string,action:string,cause:string,message:string,attrs:array<struct<key:string,value:string>>>, "
    "stats struct<started:timestamp,finished:timestamp,pages_visited:long,pages_processed:long,errors:long,assets:long,manual_retries:long>"
)


def event_log(**kinds: DataFrame) -> DataFrame:
    """One wide table from a table a kind (columns ts, seq and the fields of its struct); absent fields are null."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(EVENT)
    out = None
    for kind, df in kinds.items():
        if kind not in KINDS:
            raise ValueError(f"unknown event kind {kind!r}")
        fields = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema[kind].dataType.fields]
        own = df.select(*[
            F.lit(kind).alias("kind") if f.name == "kind" else F.struct(*fields).alias(kind) if f.name == kind
            else (F.col(f.name) if f.name in ("seq", "ts") and f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ])
        out = own if out is None else out.unionByName(own)
    return out


def attribute(attrs: Column | str, key: str) -> Column:
    """The first value of a key among an error's attributes."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.get(F.filter(a, lambda x: x["key"] == key), F.lit(0))["value"]


def stats(documents: DataFrame, visited: int, assets: int = 0) -> DataFrame:
    """One row: pages visited (admitted, fetched or not), processed, errors, assets, failures that wait for a person."""
    marked = classified(documents.select("stage", "cause"))
    return marked.agg(
        F.lit(visited).cast("long").alias("pages_visited"), F.count(F.when(F.col("cause").isNull(), 1)).alias("pages_processed"), F.count("cause").alias("errors"),
        F.lit(assets).cast("long").alias("assets"), F.count(F.when(F.col("cause").isNotNull() & (F.col("policy") == MANUAL), 1)).alias("manual_retries"),
    )


# --------------------------------------------------------------------- journal

JOURNAL = "url string, stage string, error string, retry_count int, timestamp timestamp"


def to_journal(failures: DataFrame) -> DataFrame:
    """Failures (url, stage, cause, retry_count, ts) that wait for a person, as journal rows."""
    waiting = classified(failures).filter((F.col("policy") == MANUAL) & F.col("stage").isin("fetch", "asset", "storage"))
    return waiting.select("url", "stage", F.col("cause").alias("error"), F.col("retry_count").cast("int").alias("retry_count"), F.col("ts").alias("timestamp"))


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def clear_journal(spark: SparkSession, path: str) -> None:
    """Empties a journal, whether it is there or not."""
    delete(spark, path)


def count_journal(spark: SparkSession, path: str) -> int:
    """How many rows wait in a journal."""
    return read_journal(spark, path).count()


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal rows; malformed lines are left out, and a journal that isn't there is empty."""
    try:
        return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], JOURNAL)
        raise
