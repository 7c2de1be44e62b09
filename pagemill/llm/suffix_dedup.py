"""Removal of repeated passages with suffix arrays.

A window of ``MIN_BYTES`` bytes is a repeat if the same bytes stand earlier in the corpus, documents being
ordered by doc_id (nulls last) and text. Repeated windows of a document make spans, and spans of at least
``MIN_WORDS`` words go; the earliest occurrence always stays.

Every window is anchored at its smallest hash of ``GRAM`` bytes, so equal windows have equal anchors:

1. anchors of all windows are grouped by hash, and only those that occur twice go on;
2. the stretches of text around them are sent to the shard that their anchor names, so all occurrences of any
   repeated window meet in one shard, and nothing else does;
3. each shard sorts the suffixes of its distinct stretches by induced sorting and computes the permuted longest
   common prefixes (suffix_array.py): neighbours that share MIN_BYTES bytes are occurrences of one window, of
   which the first in corpus order stays.

What many documents share reaches a shard once from every ``FLUSH_BYTES`` of text, not once from every document: an
anchor that stands twice there is known to repeat, and of equal stretches there only the earliest is sorted, while the
others are repeats all over, which only have to learn where the first stands. Replies to these go by shards of
their own, dealt evenly. The number of shards follows the bytes of text; a shard sorts blocks of anchors, each
about ``SORT_BYTES`` long. An anchor with more than ``HOT_BYTES`` of stretches, a phrase that stands in many contexts,
is split: its windows are anchored anew by longer grams, at last by all of their bytes, where only equal windows meet.

Defined results: null texts, empty ones and those under MIN_BYTES bytes have no spans and stay as they are;
rows equal in doc_id and text are one document (all of them are cut alike); documents are told apart by 128 bits of hash; a
document may be cut down to an empty text and stays; a very long text is worked through whole, by itself; spans are byte
offsets, cut at the characters that lie wholly inside; an empty table gives an empty result; other columns are carried along
and never read (n_chars, if there, follows the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, doc_columns, fresh, prefix_hash, row_chunks, space_mask, span_hash, stored, text_bytes
from .suffix_array import permuted_lcp, suffix_array

MIN_BYTES, MIN_WORDS, GRAM = 128, 50, 32
BLOCK = 1 << 18
ANCHOR_SHARD_BYTES, SHARD_BYTES = 32 << 20, 2 << 20
FLUSH_BYTES = 16 << 20
SORT_BYTES, HOT_BYTES = 2 << 20, 4 << 20
FINER = (64, MIN_BYTES)  # grams of hot anchors
BREAK = 0xFF  # not in UTF-8


def window_anchors(data: np.ndarray, offsets: np.ndarray, size: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, hash, places) of each run of neighbouring windows of one text with the same anchor, which stands at so many places in it; starts count from data[0]."""
    z = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    long = lengths >= size
    if not long.any():
        return z, z, np.zeros(0, np.uint64), z
    n = len(data)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix_hash(data), at, at + gram)
    width = size - gram + 1
    low = _sliding(np.minimum, grams, width)
    first, stop = offsets[:-1][long], offsets[1:][long] - size + 1  # windows start in [first, stop)
    mark = np.zeros(n + 1, np.int8)
    mark[first] += 1
    mark[stop] -= 1
    valid = np.cumsum(mark[: len(low)], dtype=np.int8) > 0
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[first] = True
    start = np.flatnonzero(new & valid)
    row = np.searchsorted(first, start, side="right") - 1
    end = np.minimum(np.append(start[1:], n), stop[row])
    windows, anchor = end - start, low[start]
    # places that are the smallest of some window: those not above the largest minimum of the windows over them
    high = np.empty(len(grams), np.uint64)
    if len(low) >= width:
        high[width - 1 : len(low)] = _sliding(np.maximum, low, width)
    high[: min(width - 1, len(low))] = np.maximum.accumulate(low[: width - 1])
    high[len(low) :] = np.maximum.accumulate(low[: -width : -1])[::-1][-(len(grams) - len(low)) :] if len(low) >= width else low.max()
    chosen = np.flatnonzero(grams <= high)
    known, name = np.unique(grams[chosen], return_inverse=True)
    places = np.sort(name * (n + 1) + chosen)
    own = np.searchsorted(known, anchor) * (n + 1) + start
    return start, windows, anchor, np.searchsorted(places, own + windows + width - 1) - np.searchsorted(places, own)


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The smallest (or largest) of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    head = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])) if len(order) else []
    for a, b in zip(head, np.append(head[1:], len(order)), strict=True) if len(order) else []:
        yield int(shard[order[a]]), order[a:b]


ANCHORS = "shard int, hashes binary, ua binary, ub binary, starts binary"


def _row_names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = _row_names(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "shard" else pa.binary()) for n, c in zip(names, columns, strict=True)], names)


def _anchors(shards: int):
    def flush(parts: list) -> pa.RecordBatch:
        hashes, ua, ub, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        twice = ~new
        twice[:-1] |= ~new[1:]
        known, alone = order[twice], order[~twice]
        # a repeated one goes on once, to tell others that it is, and needs no answer
        marks = order[new & twice]
        out = np.concatenate([alone, marks])
        start = np.concatenate([starts[alone], np.full(len(marks), -1, np.int32)])
        rows = [(s, *(_blob(x[out[o]]) for x in (hashes, ua, ub)), _blob(start[o])) for s, o in _split((hashes[out] % np.uint64(shards)).astype(np.int64))]
        if len(known):
            rows.append((-1 - int(ua[known[0]] % shards), b"", _blob(ua[known]), _blob(ub[known]), _blob(starts[known])))
        return _record(rows, ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            ua, ub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in row_chunks(offs, BLOCK):
                start, _, hashes, places = window_anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                # one that stands at two places in its own run counts twice
                again = np.where(places > 1, 2, 1)
                start, hashes = np.repeat(start, again), np.repeat(hashes, again)
                row = i + np.searchsorted(offs[i : j + 1] - offs[i], start, side="right") - 1
                parts.append((hashes, ua[row], ub[row], (start + offs[i] - offs[row]).astype(np.int32)))
                held += int(offs[j] - offs[i])
                if held >= FLUSH_BYTES:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _repeated(key: tuple, group: pa.Table) -> pa.Table:
    """Of one shard of anchors: the starts, by document, of those whose hash occurs twice. Shards below 0 hold such only."""
    ua, ub, starts = _joined(group["ua"], np.int64), _joined(group["ub"], np.int64), _joined(group["starts"], np.int32)
    some = np.arange(len(ua))
    if key[0].as_py() >= 0:
        hashes = _joined(group["hashes"], np.uint64)
        order = np.argsort(hashes)
        h = hashes[order]
        same = h[1:] == h[:-1]
        twice = starts[order] < 0
        twice[1:] |= same
        twice[:-1] |= same
        some = order[twice]
        some = some[starts[some] >= 0]
    some = some[np.lexsort((ub[some], ua[some]))]
    u, v, s = ua[some], ub[some], starts[some]
    head = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, np.int64)
    offsets = np.append(head, len(u)).astype(np.int64) * 4
    blobs = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_blob(s))])
    return pa.table({"ua": pa.array(u[head]), "ub": pa.array(v[head]), "starts": blobs.cast(pa.binary())})


#: Of stretches to sort, bytes and hashes, and in ``more`` whether others refer to them; of repeats all over, in ``more`` the words before their end and in ra, rb and rs the document and place of the stretch that they equal.
SEGMENTS = "shard int, bytes binary, lens binary, hashes binary, ua binary, ub binary, ids binary, starts binary, words binary, more binary, ra binary, rb binary, rs binary"


def _inner_words(data: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running count of word starts strictly inside segments, so that ordinals hold at any of their places."""
    space = space_mask(data)
    begins = np.append(False, ~space[1:] & space[:-1]) if len(data) else np.zeros(0, bool)
    begins[head[size > 0]] = False
    return np.append(0, np.cumsum(begins, dtype=np.int32))


def _segments(shards: int):
    def flush(parts: list) -> pa.RecordBatch:
        data, size, hashes, ua, ub, ids, starts, words, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.cumsum(size, dtype=np.int64) - size
        raw, first = data.tobytes(), {}
        order = np.lexsort((starts, ub, ua, ids))
        like = np.empty(len(size), np.int64)
        for k, i, n in zip(order.tolist(), at[order].tolist(), size[order].tolist(), strict=True):
            like[k] = first.setdefault(raw[i : i + n], k)
        own = like == np.arange(len(size))
        equal = (ids == ids[like]) & (ua == ua[like]) & (ub == ub[like]) & (starts == starts[like])
        later = np.flatnonzero(~own & ~equal)
        referred = np.zeros(len(size), np.int32)
        referred[like[later]] = 1
        lead = np.flatnonzero(own)
        rows = []
        for s, part in _split((hashes[lead] % np.uint64(shards)).astype(np.int64)):
            o = lead[part]
            n = size[o].astype(np.int64)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows.append((s, _blob(data[np.repeat(at[o], n) + inner]), *(_blob(x[o]) for x in (size, hashes, ua, ub, ids, starts, words, referred)), b"", b"", b""))
        if len(later):
            o, to = later, like[later]
            rows.append((-1 - int(ua[later[0]] % shards), b"", _blob(size[o]), b"", *(_blob(x[o]) for x in (ua, ub, ids, starts, words)), _blob(stop[o]), _blob(ua[to]), _blob(ub[to]), _blob(starts[to])))
        return _record(rows, SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offs = text_bytes(batch.column(3))
            ua, ub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = np.where(batch.column(2).is_valid().to_numpy(zero_copy_only=False), batch.column(2).fill_null(0).to_numpy(), np.iinfo(np.int64).max)
            for i, j in row_chunks(offs, BLOCK):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                start, windows, hashes, _ = window_anchors(part, o)
                wanted = [np.frombuffer(b"".join(x), np.int32) + o[k] for k, x in enumerate(batch.column(4).slice(i, j - i).to_pylist())]
                good = np.isin(start, np.concatenate(wanted)) if wanted else np.zeros(len(start), bool)
                start, windows, hashes = start[good], windows[good], hashes[good]
                if not len(start):
                    continue
                row = np.searchsorted(o, start, side="right") - 1
                space = space_mask(part)
                before = np.ones(len(part), bool)
                before[1:] = space[:-1]
                before[o[:-1][np.diff(o) > 0]] = True
                begins = ~space & before
                count = np.append(0, np.cumsum(begins))  # word starts before each byte
                ordinal = (count[start] - count[o[row]]) * 2 + begins[start]
                size = windows + MIN_BYTES - 1
                stop = count[start + size] - count[o[row]]
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                parts.append((part[np.repeat(start, size) + inner], size.astype(np.int32), hashes, ua[i + row], ub[i + row], ids[i + row], (start - o[row]).astype(np.int32), ordinal.astype(np.int32), stop.astype(np.int32)))
                held += int(size.sum())
                if held >= FLUSH_BYTES:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


#: A repeat (origin false), or where the first window of the stretch at lo of a document stands first (origin true). A repeat without first_doc_id and first_lo has those of the stretch at rs of (ra, rb).
FOUND = "ua long, ub long, doc_id long, lo int, hi int, words_lo int, words_hi int, first_doc_id long, first_lo int, ra long, rb long, rs int, origin boolean"


def find_repeats(segments: list[bytes], owner: np.ndarray, base: np.ndarray, doc_rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(occurrence, from, to, first rank, first start), and of each segment's first window (first rank, first start): the runs of repeated windows in occurrences ``owner`` of distinct ``segments``, which begin at ``base`` in the document of rank ``doc_rank``; from and to are windows of the segment."""
    lens = np.array([len(s) for s in segments], np.int64)
    text = np.full(int((lens + 1).sum()), BREAK, np.uint8)
    at = np.cumsum(lens + 1) - lens - 1
    inner = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    text[np.repeat(at, lens) + inner] = np.frombuffer(b"".join(segments), np.uint8)
    order = suffix_array(text)
    plcp = permuted_lcp(text, order)

    key = (doc_rank.astype(np.int64) << 32) | base
    first = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(first, owner, key)
    windows = lens - MIN_BYTES + 1
    segment = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    flat = np.full(len(text), -1, np.int64)
    flat[at[segment] + offset] = np.arange(len(segment))

    ranked = flat[order]
    group = np.cumsum(plcp[order] < MIN_BYTES)
    kept = ranked >= 0
    ranked, group = ranked[kept], group[kept]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat((first[segment] + offset)[ranked], head)
    source = np.empty(len(segment), np.int64)
    source[ranked] = np.repeat(least, np.diff(np.append(head, len(group))))

    # an occurrence that isn't its segment's first is a repeat all over
    later = np.flatnonzero(key != first[owner])
    begin = np.cumsum(windows) - windows
    # of the first ones, the runs of windows that stand earlier in another segment
    flagged = source != first[segment] + offset
    new = flagged & np.append(True, ~flagged[:-1] | (segment[1:] != segment[:-1]))
    last = flagged & np.append(~flagged[1:] | (segment[1:] != segment[:-1]), True)
    lo, hi = np.flatnonzero(new), np.flatnonzero(last) + 1
    holder = np.full(len(segments), -1, np.int64)
    holder[owner[::-1][(key == first[owner])[::-1]]] = np.flatnonzero(key == first[owner])[::-1]
    occurrence = np.concatenate([later, holder[segment[lo]]])
    start = np.concatenate([np.zeros(len(later), np.int64), offset[lo]])
    stop = np.concatenate([windows[owner[later]], offset[hi - 1] + 1])
    origin = source[np.concatenate([begin[owner[later]], lo])] if len(occurrence) else np.zeros(0, np.int64)
    return occurrence, start, stop, origin >> 32, origin & 0xFFFFFFFF, source[begin] >> 32, source[begin] & 0xFFFFFFFF


def _found(columns: list[np.ndarray]) -> pa.Table:
    """A table of FOUND from its columns, in which the largest doc_id stands for none, and first_lo below 0 for no place."""
    none, arrays = np.iinfo(np.int64).max, []
    for text, x in zip(FOUND.split(", "), columns, strict=True):
        name, kind = text.split()
        if kind == "long":
            arrays.append(pa.array(x, pa.int64(), mask=x == none if "doc_id" in name else None))
        else:
            arrays.append(pa.array(x.astype(bool)) if kind == "boolean" else pa.array(x, pa.int32(), mask=x < 0 if name == "first_lo" else None, safe=False))
    return pa.table(arrays, _row_names(FOUND))


def _resplit(gram: int, data: bytes, lens: np.ndarray, hashes: np.ndarray, *about: np.ndarray) -> tuple:
    """The same stretches, those of hot anchors split into shorter ones by anchors of longer grams; ``about`` is ua, ub, ids, starts, words, more."""
    _, name = np.unique(hashes, return_inverse=True)
    held = np.bincount(name, lens) if len(lens) else np.zeros(0)
    hot = held[name] > HOT_BYTES if len(lens) else np.zeros(0, bool)
    if not hot.any():
        return data, lens, hashes, *about
    flat, at = np.frombuffer(data, np.uint8), np.cumsum(lens) - lens

    def bytes_of(rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return flat[np.repeat(at[rows] + begin, size) + inner]

    cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
    parts = [(bytes_of(cold, np.zeros(len(cold), np.int64), lens[cold]), lens[cold], hashes[cold], *(x[cold] for x in about))]
    offsets = np.append(0, np.cumsum(lens[warm]))
    for i, j in row_chunks(offsets, BLOCK):
        rows = warm[i:j]
        part, o = bytes_of(rows, np.zeros(len(rows), np.int64), lens[rows]), offsets[i : j + 1] - offsets[i]
        start, windows, finer, _ = window_anchors(part, o, MIN_BYTES, gram)
        row = np.searchsorted(o, start, side="right") - 1
        begin, own = start - o[row], rows[row]
        ua, ub, ids, starts, words, more = (x[own] for x in about)
        count = _inner_words(part, o[:-1], np.diff(o))
        before = (words >> 1) + np.where(begin > 0, (words & 1) + count[start] - count[o[row]], 0)
        here = np.where(begin > 0, count[start + 1] - count[start], words & 1)
        size = windows + MIN_BYTES - 1
        parts.append((bytes_of(own, begin, size), size, finer, ua, ub, ids, starts + begin, before * 2 + here, np.where(begin > 0, 0, more)))
    merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return merged[0].tobytes(), *merged[1:]


def _sorted_shard(key: tuple, group: pa.Table) -> pa.Table:
    lens = _joined(group["lens"], np.int32).astype(np.int64)
    ua, ub, ids = (_joined(group[c], np.int64) for c in ("ua", "ub", "ids"))
    starts, words, more = (_joined(group[c], np.int32).astype(np.int64) for c in ("starts", "words", "more"))
    z = np.zeros(len(lens), np.int64)
    if key[0].as_py() < 0:  # repeats all over
        return _found([ua, ub, ids, starts, starts + lens, words >> 1, more, z + np.iinfo(np.int64).max, z - 1, _joined(group["ra"], np.int64), _joined(group["rb"], np.int64), _joined(group["rs"], np.int32), z])
    hashes = _joined(group["hashes"], np.uint64)
    data = b"".join(group["bytes"].to_pylist())
    for gram in FINER:
        data, lens, hashes, ua, ub, ids, starts, words, more = _resplit(gram, data, lens, hashes, ua, ub, ids, starts, words, more)
    at = np.cumsum(lens) - lens
    order = np.argsort(hashes, kind="stable")
    out: list[list[np.ndarray]] = []

    def finish(some: np.ndarray, owner: np.ndarray, segments: list[bytes]) -> None:
        docs, rank = np.unique(np.stack([ids[some], ua[some], ub[some]], 1), axis=0, return_inverse=True)
        which, start, stop, first_rank, first_lo, origin_rank, origin_lo = find_repeats(segments, owner, starts[some], rank.reshape(-1))
        asked = np.flatnonzero(more[some])
        if len(asked):
            row, n = some[asked], np.zeros(len(asked), np.int64)
            out.append([ua[row], ub[row], ids[row], starts[row], n, n, n, docs[origin_rank[owner[asked]], 0], origin_lo[owner[asked]], n, n, n, n + 1])
        if not len(which):
            return
        row, n = some[which], np.zeros(len(which), np.int64)
        hi = stop + MIN_BYTES - 1
        size = np.array([len(s) for s in segments], np.int64)
        head = np.cumsum(size) - size
        count = _inner_words(np.frombuffer(b"".join(segments), np.uint8), head, size)
        base, own = words[row] >> 1, words[row] & 1
        place = lambda x: base + np.where(x > 0, own + count[head[owner[which]] + x] - count[head[owner[which]]], 0)
        out.append([ua[row], ub[row], ids[row], starts[row] + start, starts[row] + hi, place(start), place(hi), docs[first_rank, 0], first_lo, n, n, n, n])

    segments: dict[bytes, int] = {}
    owner, some, held, i = [], [], 0, 0
    h = hashes[order]
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)) if len(h) else []
    for end in ends:
        for k in order[i:end].tolist():
            seg = data[at[k] : at[k] + lens[k]]
            n = len(segments)
            got = segments.setdefault(seg, n)
            held += len(seg) if got == n else 0
            owner.append(got)
            some.append(k)
        i = end
        if held >= SORT_BYTES:
            finish(np.array(some), np.array(owner), list(segments))
            segments, owner, some, held = {}, [], [], 0
    if some:
        finish(np.array(some), np.array(owner), list(segments))
    return _found([np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 13)


def _uids() -> list[Column]:
    """Two hashes that name a document, 128 bits together."""
    return [F.xxhash64("doc_id", "text").alias("ua"), F.xxhash64(F.lit(1), "text", "doc_id").alias("ub")]


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id, first_start, uid) of the spans that go; offsets are bytes, and the span's first window stands first at first_start of first_doc_id."""
    rows = doc_columns(docs).filter(F.octet_length("text") >= MIN_BYTES).select("doc_id", "text", *_uids())
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    anchor_shards, shards = max(1, -(-total // ANCHOR_SHARD_BYTES)), max(1, -(-total // SHARD_BYTES))
    anchors = rows.select("ua", "ub", "text").mapInArrow(_anchors(anchor_shards), ANCHORS)
    starts = anchors.groupBy("shard").applyInArrow(_repeated, "ua long, ub long, starts binary")
    wanted = starts.groupBy("ua", "ub").agg(F.collect_list("starts").alias("starts"))
    segments = rows.join(wanted, ["ua", "ub"]).select("ua", "ub", "doc_id", "text", "starts").mapInArrow(_segments(shards), SEGMENTS)
    # stored: repeats and origins are read from it
    found = stored(segments.groupBy("shard").applyInArrow(_sorted_shard, FOUND))

    w = Window.partitionBy("ua", "ub").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.filter("not origin").withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # all that begin at one place have the same first window
    first = F.min(F.struct("lo", F.col("first_lo").isNull().alias("none"), "first_doc_id", "first_lo", "ra", "rb", "rs"))
    spans = merged.groupBy("ua", "ub", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("lo").alias("start"), F.max("hi").alias("end"),
        (F.max("words_hi") - F.min("words_lo")).alias("n_words"), first.alias("first"),
    )
    spans = spans.filter(F.col("n_words") >= min_words).select("*", "first.none", "first.first_doc_id", "first.first_lo", "first.ra", "first.rb", "first.rs")
    origins = found.filter("origin").groupBy(F.col("ua").alias("ra"), F.col("ub").alias("rb"), F.col("lo").alias("rs")).agg(F.min(F.struct("first_doc_id", "first_lo")).alias("o"))
    joined = spans.join(origins, ["ra", "rb", "rs"], "left")
    pick = lambda c: F.when(F.col("none"), F.col(f"o.{c}")).otherwise(F.col(c))
    return joined.select("doc_id", "start", "end", "n_words", pick("first_doc_id").alias("first_doc_id"), pick("first_lo").alias("first_start"), F.struct("ua", "ub").alias("uid"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` less the byte spans, all in the JVM; a character that a span holds only in part stays."""
    raw = text.cast("binary")

    def inside(p: Column) -> Column:
        byte = F.substring(raw, p + 1, F.lit(1))
        return (p < F.octet_length(text)) & (byte >= F.lit(b"\x80")) & (byte <= F.lit(b"\xbf"))

    up = lambda p: F.when(~inside(p), p).when(~inside(p + 1), p + 1).when(~inside(p + 2), p + 2).otherwise(p + 3)
    down = lambda p: F.when(~inside(p), p).when(~inside(p - 1), p - 1).when(~inside(p - 2), p - 2).otherwise(p - 3)
    sound = F.transform(F.array_sort(spans), lambda s: F.struct(up(s["start"]).alias("start"), down(s["end"]).alias("end")))
    begins = F.concat(F.array(F.lit(0)), F.transform(sound, lambda s: s["end"]))
    ends = F.concat(F.transform(sound, lambda s: s["start"]), F.array(F.octet_length(text)))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))).cast("string")), "")


def drop_repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns and rows, with the texts less their repeated spans."""
    ua, ub, cut = fresh(docs, "pm_ua"), fresh(docs, "pm_ub"), fresh(docs, "pm_spans")
    spans = repeated_spans(docs, min_words).groupBy(F.col("uid.ua").alias(ua), F.col("uid.ub").alias(ub)).agg(F.collect_list(F.struct("start", "end")).alias(cut))
    spans = bounded(stored(spans))
    a, b = (F.xxhash64(*x) for x in ((F.col("doc_id").cast("long"), F.col("text").cast("string")), (F.lit(1), F.col("text").cast("string"), F.col("doc_id").cast("long"))))
    joined = docs.withColumns({ua: a, ub: b}).join(spans, [ua, ub], "left")
    text = F.when(F.col(cut).isNull(), F.col("text").cast("string")).otherwise(_without(F.col("text").cast("string"), F.col(cut))).cast(docs.schema["text"].dataType)
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
