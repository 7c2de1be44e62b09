"""Files that a crawl leaves: Markdown documents, assets, and dumps of the stages. Written by the executors.

A file is written under a passing name and moved to its own, so a task that runs again leaves the same file. Writers
return the manifest of what they wrote; without a folder they are dry and only say what they would write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing

MANIFEST = "url_hash string, path string, content_hash string"
_STAGES = (("html", "01_fetcher.html"), ("extracted_html", "02_extractor.html"), ("content_html", "03_sanitizer.html"), ("converted", "04_mdconvert.md"), ("markdown", "05_asset_resolver.md"))


def _uri(folder: str) -> str:
    return folder.rstrip("/") if "://" in folder else f"file://{folder.rstrip('/')}"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, cause) of files (path, bytes), each written to its path in the folder; of several rows of a path the smallest bytes stay. A file that can't be written has a cause."""
    top = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(top)
        made: set[str] = set()
        for batch in batches:
            causes = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent = f"{base}/{path}".rsplit("/", 1)[0]
                passing = f"{base}/{path}.{uuid.uuid4().hex}.part"
                try:
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    with system.open_output_stream(passing) as out:
                        out.write(raw)
                    system.move(passing, f"{base}/{path}")
                    causes.append(None)
                except OSError as e:
                    causes.append("disk is full" if e.errno == 28 else "write failed")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(causes, pa.string())], ["path", "cause"])

    once = files.filter("path is not null and bytes is not null").groupBy("path").agg(F.min("bytes").alias("bytes"))
    return once.select("path", "bytes").mapInArrow(run, "path string, cause string")


def manifest(documents: DataFrame) -> DataFrame:
    """(url_hash, path, content_hash) of sound documents: what the Markdown sink writes, a row a file, the first page by page_id where two have one name."""
    w = Window.partitionBy("file").orderBy("page_id", "content_hash")
    first = documents.filter("cause is null and file is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return first.select(F.substring("file", 1, 12).alias("url_hash"), F.col("file").alias("path"), "content_hash", "markdown")


def write_markdown(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(url_hash, path, content_hash, cause): the Markdown of every sound document, without its record, in <url hash>.md; an older file goes. Lazy: the files are there when the result was computed."""
    held = manifest(documents)
    if folder is None:
        return held.drop("markdown").withColumn("cause", F.lit(None).cast("string"))
    done = write_files(held.select("path", F.col("markdown").cast("binary").alias("bytes")), folder)
    return held.drop("markdown").join(done, "path").select("url_hash", "path", "content_hash", "cause")


def write_assets(kept: DataFrame, fetched: DataFrame, folder: str) -> DataFrame:
    """(path, cause) of the assets that ``operators.assets.kept`` calls new, with the bytes of ``fetched`` (url, bytes)."""
    new = kept.filter("new and path is not null").join(fetched.select(F.col("url").alias("resolved"), "bytes"), "resolved")
    return write_files(new.select("path", "bytes"), folder)


def dump_stages(pages: DataFrame, folder: str) -> DataFrame:
    """(path, cause): up to five files a page, in a folder named by its raw URL's SHA-256. ``pages`` has url and any of html, extracted_html, content_html, converted, markdown."""
    at = F.substring(hashing.digest("url"), 1, 12)
    files: list[Column] = [F.struct(F.concat(at, F.lit(f"/{name}")).alias("path"), F.col(c).cast("binary").alias("bytes")) for c, name in _STAGES if c in pages.columns]
    each = pages.select(F.explode(F.array(*files)).alias("f")).select("f.path", "f.bytes")
    return write_files(each, folder)
