from __future__ import annotations

import hashlib

import numpy as np
import pytest

from pagemill.llm import common
from pagemill.llm import exact_dedup as ed
from tests.llm.helpers import docs, sample, with_clashes


def digests(n):
    return np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(n)), np.uint64).reshape(-1, 4)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash_is_minimal_and_perfect(n):
    d = digests(n)
    sizes, bits = ed.build_mph(d)
    assert sorted(ed.mph_slots(d, sizes, bits)) == list(range(n))


ROWS = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (1, "b"), (2, None), (2, None), (7, ""), (8, ""), (9, "c"), (9, "d"), (None, "n"), (None, "n"), (4, "x" * 200_000), (6, "x" * 200_000)]


def brute(rows, history=()):
    """Rows that stay: of a text in the history none, else the smallest doc_id."""
    known, out = {t for _, t in history}, []
    best = {}
    for i, t in rows:
        if t is None:
            out.append((i, t))
        elif t not in known:
            order = (i is None, i or 0)
            best[t] = min(best.get(t, order), order)
    return sorted(map(str, out + [(None if none else i, t) for t, (none, i) in best.items()]))


def kept(df):
    return sorted(map(str, [(r.doc_id, r.text) for r in df.collect()]))


@pytest.mark.parametrize("most", [0, 250_000])
def test_rows_that_stay(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    df = with_clashes(docs(spark, ROWS))
    out = ed.drop_exact_repeats(df)
    assert out.columns == df.columns
    assert kept(out) == brute(ROWS)
    gone = {(r.doc_id, r.kept_doc_id): r.n_rows for r in ed.exact_repeats(df).collect()}
    assert gone == {(5, 3): 1, (3, 3): 1, (None, 3): 1, (8, 7): 1, (None, None): 1, (6, 4): 1}


def test_history(spark, monkeypatch):
    monkeypatch.setattr(ed, "PER_SHARD", 2)
    history = [(100, "a"), (90, "a"), (80, "c"), (70, None), (60, "zz"), (50, "yy")]
    df, old = docs(spark, ROWS), docs(spark, history)
    assert kept(ed.drop_exact_repeats(df, old)) == brute(ROWS, history)
    gone = {(r.doc_id, r.kept_doc_id): r.n_rows for r in ed.exact_repeats(df, old).collect()}
    assert gone == {(5, 90): 1, (3, 90): 2, (None, 90): 1, (9, 80): 1, (8, 7): 1, (None, None): 1, (6, 4): 1}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert ed.drop_exact_repeats(none).collect() == [] and ed.exact_repeats(none).collect() == []
    assert kept(ed.drop_exact_repeats(docs(spark, ROWS), none)) == brute(ROWS)


def test_sample_against_brute_force(spark):
    rows = [(int(i), t) for i, t in zip(*sample()[["doc_id", "text"]].values.T, strict=True)]
    assert kept(ed.drop_exact_repeats(docs(spark, rows))) == brute(rows)


def test_an_earlier_half_as_history_changes_nothing(spark):
    rows = [(k, f"text {k % 7}") for k in range(20)] + [(20 + k, f"late {k % 3}") for k in range(9)] + [(3, "text 3"), (28, "late 2"), (None, "text 1"), (None, "only null"), (None, "only null"), (5, None), (6, "")]
    df = docs(spark, rows)
    half = ed.earlier_half(df)
    assert 0 < half.count() < df.count()
    key = lambda d: sorted(map(str, map(tuple, d.collect())))
    want = key(ed.exact_repeats(df))
    assert want and key(ed.exact_repeats(df, half, inside=True)) == want
    index, shards = ed.build_index(half)
    members = {r.member for r in ed.lookup(df, index, shards).collect()}
    assert members == {True, False}
    assert ed.exact_repeats(df.limit(0), ed.earlier_half(df.limit(0)), inside=True).isEmpty()
