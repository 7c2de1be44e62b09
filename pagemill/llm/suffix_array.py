"""Suffix arrays by induced sorting, in numpy, and permuted longest common prefixes.

``suffix_array`` classifies the suffixes of a string as S (smaller than the next) or L, and its leftmost S-type (LMS)
places. It induces the order of the LMS substrings from the LMS places in any order of their buckets, names them
by comparing neighbours, sorts the string of names by calling itself until no name stands twice, and induces the
L-type and then the S-type suffixes from the sorted LMS suffixes. All of it is linear work.

A suffix induces the one before it, which goes into the bucket of its own first symbol. Buckets are taken many at
once: from a first bucket on as far as none is reached from another one among them, which for a large alphabet is
about a root of the length in buckets. Runs of one symbol, which reach their own bucket, go in by how far from the end of the run they are.

``permuted_lcp`` compares only at irreducible positions (those whose predecessor byte differs from that of
their neighbour in the array) and fills the others, each one less than the position before.
"""

from __future__ import annotations

import numpy as np

#: Called with (length, names) at every recursion, for tests.
ON_RECURSION = None


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end of the text counts as smallest of all."""
    n = len(text)
    stype = np.zeros(n, bool)
    if n < 2:
        return stype
    less, differ = text[:-1] < text[1:], text[:-1] != text[1:]
    at = np.where(differ, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    stype[:-1] = np.where(following < n - 1, less[np.minimum(following, n - 2)], False)
    return stype


def _batches(low: np.ndarray, high: np.ndarray, sigma: int) -> list[int]:
    """Edges of batches of symbols, such that no pair low < high has both in one batch."""
    # the nearest symbol that is reached from each one or a later one
    reach = np.full(sigma + 1, sigma, np.int64)
    np.minimum.at(reach, low, high)
    reach = np.minimum.accumulate(reach[::-1])[::-1].tolist()
    edges = [0]
    while edges[-1] < sigma:
        edges.append(reach[edges[-1]])
    return edges


def _append(out: np.ndarray, fill: np.ndarray, chars: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Puts suffixes, in the order given, at the next free places of their buckets, forwards or backwards."""
    order = chars.argsort(kind="stable")
    c = chars[order]
    m = len(c)
    new = np.empty(m, bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    head = new.nonzero()[0]
    if len(head) == m:  # a bucket each
        out[fill[c]] = suffixes[order]
        fill[c] += step
        return
    size = np.empty(len(head), np.int64)
    size[:-1] = head[1:] - head[:-1]
    size[-1] = m - head[-1]
    nth = np.arange(m) - head.repeat(size)
    out[fill[c] + nth if step > 0 else fill[c] - nth] = suffixes[order]
    fill[c[head]] += step * size


def _runs(out: np.ndarray, fill: np.ndarray, text: np.ndarray, before: np.ndarray, some: np.ndarray, step: int) -> None:
    """From the suffixes given, in bucket order, those before them in their runs of one symbol: all that are one place away, then two, and so on."""
    size = before[some]
    if not size.any():
        return
    own = np.repeat(np.arange(len(some)), size)
    away = np.arange(1, len(own) + 1) - np.repeat(np.cumsum(size) - size, size)
    order = away.argsort(kind="stable")
    suffixes = some[own[order]] - away[order]
    _append(out, fill, text[suffixes], suffixes, step)


def _induce(text: np.ndarray, stype: np.ndarray, run: np.ndarray, lms: np.ndarray, edges: tuple[list[int], list[int]], count: np.ndarray) -> np.ndarray:
    """All suffixes, from LMS places in an order that is right within each bucket."""
    n = len(text)
    end = np.cumsum(count)
    begin = end - count
    bounds = np.append(begin, n)
    out = np.full(n, -1, np.int64)
    ltype = ~stype
    other = np.append(text[1:] != text[:-1], False)  # the next symbol is another one
    sends = ltype & other
    if len(lms):
        # at the ends of their buckets
        order = np.argsort(text[lms], kind="stable")
        c = text[lms[order]]
        mine = np.bincount(c, minlength=len(count))
        out[np.arange(len(c)) - (np.cumsum(mine) - mine)[c] + end[c] - mine[c]] = lms[order]
    fill = begin.copy()
    # the end of the text induces its last suffix, which is L-type
    out[fill[text[n - 1]]] = n - 1
    fill[text[n - 1]] += 1
    for a, b in zip(edges[0][:-1], edges[0][1:], strict=True):
        lo, hi = bounds[a], bounds[b]
        if lo == hi:
            continue
        part = out[lo:hi]
        some = part[part >= 0]
        if not len(some):
            continue
        some = some[ltype[some]]
        if len(some) and run[some].any():
            _runs(out, fill, text, run, some, 1)
        some = part[part >= 0]
        before = some[some > 0] - 1
        before = before[sends[before]]
        if len(before):
            _append(out, fill, text[before], before, 1)
    # the S-type ones come anew, from behind
    tail = np.ones(n, bool)
    size = fill - begin
    tail[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)] = False
    out[tail] = -1
    fill, sends = end - 1, stype & other
    for a, b in zip(edges[1][-2::-1], edges[1][:0:-1], strict=True):
        lo, hi = bounds[a], bounds[b]
        if lo == hi:
            continue
        part = out[lo:hi]
        some = part[part >= 0][::-1]
        if not len(some):
            continue
        some = some[stype[some]]
        if len(some) and run[some].any():
            _runs(out, fill, text, run, some, -1)
        some = part[part >= 0][::-1]
        before = some[some > 0] - 1
        before = before[sends[before]]
        if len(before):
            _append(out, fill, text[before], before, -1)
    return out


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether so many symbols from a on equal those from b on."""
    same, todo = np.ones(len(a), bool), np.flatnonzero(size > 0)
    width = text.dtype.itemsize
    per = 8 // width
    words = np.ndarray((len(text) + 1,), np.uint64, np.concatenate([text, np.zeros(per + 1, text.dtype)]), strides=(width,))  # the symbols from any place on
    done = 0
    while len(todo):
        left = size[todo] - done
        diff = words[a[todo] + done] ^ words[b[todo] + done]
        short = left < per
        if short.any():
            diff[short] &= (np.uint64(1) << (left[short] * 8 * width).astype(np.uint64)) - np.uint64(1)
        same[todo[diff != 0]] = False
        todo = todo[(diff == 0) & (left > per)]
        done += per
    return same


def suffix_array(text: np.ndarray, sigma: int = 256) -> np.ndarray:
    """The suffixes of ``text`` (symbols below ``sigma``), smallest first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.uint8 if sigma <= 1 << 8 else np.uint16 if sigma <= 1 << 16 else np.uint32, copy=False)
    count = np.bincount(text, minlength=sigma)
    stype = classify(text)
    # how many of the same symbol stand right before each place
    at = np.arange(n, dtype=np.int32)
    run = at - np.maximum.accumulate(np.where(np.append(True, text[1:] != text[:-1]), at, 0))
    del at
    # L-type suffixes come from smaller first symbols, S-type ones from larger
    apart = np.flatnonzero(text[1:] != text[:-1])
    down = apart[~stype[apart]]
    up = apart[stype[apart]]
    back = sigma - 1
    edges = (
        _batches(text[down + 1].astype(np.int64), text[down].astype(np.int64), sigma),
        [sigma - e for e in _batches(back - text[up + 1].astype(np.int64), back - text[up].astype(np.int64), sigma)][::-1],
    )
    del apart, down, up
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    if not len(lms):
        return _induce(text, stype, run, lms, edges, count)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = _induce(text, stype, run, lms, edges, count)
    by_substring = by_substring[is_lms[by_substring]]
    ends = np.append(lms[1:], n - 1)  # each substring reaches to the next LMS place, which belongs to it
    size = np.zeros(n, np.int32)
    size[lms] = ends - lms + 1
    size[lms[-1]] += 1  # and the last one to the end of the text, which no other holds
    a, b = by_substring[:-1], by_substring[1:]
    alike = size[a] == size[b]
    alike[alike] = _same(text, a[alike], b[alike], size[a[alike]])
    name = np.append(0, np.cumsum(~alike))
    if name[-1] + 1 == len(lms):
        return _induce(text, stype, run, by_substring, edges, count)
    del size, is_lms, alike
    at = np.empty(n, np.int32)
    at[by_substring] = name
    del by_substring
    if ON_RECURSION is not None:
        ON_RECURSION(len(lms), int(name[-1]) + 1)
    order = suffix_array(at[lms], int(name[-1]) + 1)
    return _induce(text, stype, run, lms[order], edges, count)


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every position, how many symbols its suffix shares with the one before it in the array; 0 for the first."""
    n = len(text)
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    at = np.arange(n)
    left = np.where((at > 0) & (phi > 0), text[at - 1] != text[phi - 1], True)
    at = np.flatnonzero(left & (phi >= 0))
    extended = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), np.uint64, extended, strides=(1,))  # the eight bytes from any position on
    a, b, own = at.copy(), phi[at], np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    while len(todo):
        x = words[a[todo] + own[todo]]
        y = words[b[todo] + own[todo]]
        diff = x ^ y
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        room = n - np.maximum(a[todo], b[todo]) - own[todo]
        step = np.minimum(same, room)
        own[todo] += step
        todo = todo[(step == 8) & (room > 8)]
    base = np.zeros(n, np.int64)
    base[at] = own + at
    # a reducible position has one less than the position before it
    last = np.maximum.accumulate(np.where(left & (phi >= 0), np.arange(n), -1))
    fill = np.where(last >= 0, base[np.maximum(last, 0)] - np.arange(n), 0)
    return np.where(phi >= 0, np.maximum(fill, 0), 0)
