"""Events as lines for people: what belongs to a page hangs below its fetch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row


def shortened(url: str, width: int) -> str:
    return url if len(url) <= width else url[: max(0, width - 3)] + "..."


def _attribute(attrs: list[Row] | None, key: str) -> str:
    return next((a["value"] or "" for a in attrs or [] if a["key"] == key), "")


def lines(events: Iterable[Row]) -> Iterator[str]:
    """The lines of events in their order, a page's tree at a time: fetches of pages begin one, skips and statistics stand alone."""
    page: str | None = None
    below: list[str] = []

    def ended() -> Iterator[str]:
        for k, line in enumerate(below):
            yield ("└── " if k == len(below) - 1 else "├── ") + line
        below.clear()

    for e in events:
        kind, x = e["kind"], e[e["kind"]]
        if kind == "fetch" and x["kind"] != "asset":
            yield from ended()
            page = x["url"]
            yield f"[FETCH] {page} - {x['status']} {x['content_type']} ({(x['duration_ms'] or 0) / 1000:.3f}s, depth={x['depth']})"
        elif kind in ("skip", "stats"):
            yield from ended()
            page = None
            if kind == "skip":
                yield f"[SKIP] {shortened(x['url'], 60)} - {x['reason']}"
            else:
                yield f"[STATS] visited={x['pages_visited']} processed={x['pages_processed']} errors={x['errors']} assets={x['assets']} manual_retries={x['manual_retries']}"
        else:
            if kind == "fetch":
                line = f"[FETCH] {x['url']} - {x['status']} {x['content_type']} ({(x['duration_ms'] or 0) / 1000:.3f}s)"
            elif kind == "artifact":
                line = f"[ARTIFACT] {shortened(x['source_url'] or '', 50)} -> {x['path']}" + (" (overwrite)" if x["overwrite"] else "")
            elif kind == "pipeline":
                line = f"[{x['stage']}] {'success' if x['success'] else 'failed'}" + (f" ({x['links_found']} links)" if x["links_found"] else "")
            else:
                line = f"[ERROR] {x['package']}.{x['action']} - {x['message']}"
                if not page or _attribute(x["attrs"], "page_url") != page:
                    yield from ended()
                    page = None
                    yield line
                    continue
            below.append(line)
    yield from ended()
