"""URL operators as Spark expressions: no Python runs for any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*).*$"
_CUT = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: columns that are pasted into one another are computed at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_ascii(c: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(_col(c), UPPER, LOWER)


def strip_trailing_slash(path: Column | str) -> Column:
    """A path less all its trailing slashes, but for its first character."""
    p = _col(path)
    return F.when(p.rlike("^/+$"), F.lit("/")).otherwise(F.rtrim(p, F.lit("/")))


def parts(url: Column | str) -> Column:
    """[scheme, authority, path] of an absolute URL as written, by one pattern; of anything else [it]."""
    return F.split(F.regexp_replace(_col(url), _PARTS, f"$1{_CUT}$2{_CUT}$3"), _CUT)


def _part(url: Column | str, k: int) -> Column:
    u = _col(url)
    return F.when(u.isNotNull(), bound(parts(u), lambda p: F.when(F.size(p) == 3, F.get(p, F.lit(k))).otherwise("")))


def scheme(url: Column | str) -> Column:
    return lower_ascii(_part(url, 0))


def authority(url: Column | str) -> Column:
    """Host and port (and user, if any), as written."""
    return _part(url, 1)


def _host(authority_: Column) -> Column:
    return lower_ascii(F.regexp_replace(F.substring_index(authority_, "@", -1), r":[0-9]*$", ""))


def host(url: Column | str) -> Column:
    """Lower-case host without user and port."""
    return _host(authority(url))


def path(url: Column | str) -> Column:
    return _part(url, 2)


def _without_query(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def canonical(url: Column | str) -> Column:
    """The one form of a URL: lower-case scheme and host, no default port, no trailing slash, query or fragment.

    An empty path stays empty, the path's case and a user before the host stay. What isn't an absolute URL only
    loses its query and fragment.
    """

    def whole(p: Column) -> Column:
        s, at, way = lower_ascii(F.get(p, F.lit(0))), F.get(p, F.lit(1)), F.get(p, F.lit(2))

        def joined(x: Column) -> Column:
            own = x["own"]
            port = F.when((x["s"] == "http") & own.endswith(":80"), 3).when((x["s"] == "https") & own.endswith(":443"), 4).otherwise(0)
            return F.concat(x["s"], F.lit("://"), F.substr(x["at"], F.lit(1), F.length(x["at"]) - F.length(own)), lower_ascii(F.substr(own, F.lit(1), F.length(own) - port)), strip_trailing_slash(x["way"]))

        return bound(F.struct(s.alias("s"), at.alias("at"), F.substring_index(at, "@", -1).alias("own"), way.alias("way")), joined)

    u = _col(url)
    return F.when(u.isNotNull(), bound(parts(u), lambda p: F.when(F.size(p) == 3, whole(p)).otherwise(_without_query(F.get(p, F.lit(0))))))


def is_absolute(url: Column | str) -> Column:
    return _col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def remove_dot_segments(path_: Column | str) -> Column:
    """RFC 3986 dot-segment removal, as a fold over the segments of an absolute path; one without any stays as it is."""
    one = F.lit(1)

    def step(acc: Column, s: Column) -> Column:
        shorter = F.slice(acc, one, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == "..", F.when(F.size(acc) > 1, shorter).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    def folded(parts_: Column) -> Column:
        kept = F.aggregate(F.slice(parts_, F.lit(2), F.greatest(F.size(parts_) - 1, F.lit(0))), F.array(F.lit("")), step)
        ended = F.when(F.element_at(parts_, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return bound(F.array_join(F.concat(kept, ended), "/"), lambda x: F.when(x == "", F.lit("/")).otherwise(x))

    p = _col(path_)
    return F.when(F.contains(p, F.lit("/.")), bound(F.split(p, "/"), folded)).otherwise(p)


def resolve(raw: Column | str, base_scheme: Column | str, base_host: Column | str) -> Column:
    """A reference against the root of a site (not against the page it stands on); absolute ones stay as they are."""
    r, s, h = _col(raw), _col(base_scheme), _col(base_host)

    def placed(x: Column) -> Column:
        own, network = x["own"], x["own"].startswith("//")
        other = F.substring_index(F.substr(own, F.lit(3)), "/", 1)
        way = F.when(network, F.substr(own, F.length(other) + 3)).when((own == "") | own.startswith("/"), own).otherwise(F.concat(F.lit("/"), own))
        return F.concat(s, F.lit("://"), F.when(network, other).otherwise(h), bound(way, remove_dot_segments), F.substr(x["raw"], F.length(own) + 1))

    return F.when(is_absolute(r), r).otherwise(bound(F.struct(r.alias("raw"), _without_query(r).alias("own")), placed))


def resolve_on(raw: Column | str, page: Column | str) -> Column:
    """A reference that stands on a page, against the root of the page's site; null if it is relative and the page's URL isn't absolute."""
    r = _col(raw)
    at = lambda p: resolve(r, lower_ascii(F.get(p, F.lit(0))), F.get(p, F.lit(1)))
    return F.when(is_absolute(r), r).otherwise(bound(parts(page), lambda p: F.when(F.size(p) == 3, at(p))))


def same_host(url: Column | str, wanted: Column | str) -> Column:
    """Whether a URL is on a host, in any case. The URL's port is ignored; a port in ``wanted`` never matches."""
    return host(url) == lower_ascii(wanted)


def extension(path_: Column | str) -> Column:
    """What follows the last dot of the last segment; empty if there is none."""
    return F.regexp_extract(_col(path_), r"\.([^./]*)$", 1)


def link_kind(tag: Column | str, raw: Column | str) -> Column:
    return F.when(_col(tag) == "img", "image").when(_col(raw).startswith("#"), "anchor").otherwise("navigation")


def truncated(url: Column | str, width: int) -> Column:
    u = _col(url)
    return F.when(F.length(u) <= width, u).otherwise(F.concat(F.substring(u, 1, max(0, width - 3)), F.lit("...")))


def section(url: Column | str, prefixes: tuple[str, ...] = ("/",)) -> Column:
    """The first path segment after the first of ``prefixes`` that the path starts with; null if nothing is left."""

    def first(p: Column) -> Column:
        rest = p
        for prefix in reversed(prefixes):
            rest = F.when(p.startswith(prefix), F.substr(p, F.lit(len(prefix) + 1))).otherwise(rest)
        return F.when(~p.isin("", "/"), F.get(F.filter(F.split(rest, "/"), lambda s: s != ""), F.lit(0)))

    return bound(path(canonical(url)), first)
