from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import suffix_array as sa
from pagemill.llm import suffix_dedup as sd
from tests.llm.helpers import CLASHES, docs, sample, with_clashes


def brute_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("seed", [2, 1024])
def test_suffix_array_and_prefixes_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    for k in range(300):
        text = np.tile(rng.integers(0, rng.integers(1, 6), rng.integers(0, 50)).astype(np.uint8), 1 + k % 3)
        order = sa.suffix_array(text)
        assert order.tolist() == brute_order(text)
        plcp = sa.permuted_lcp(text, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert plcp[b] == n


def test_prose_is_sorted_by_recursion_at_any_number_of_names(monkeypatch):
    data = np.frombuffer("\xff".join(sample("sf0.01").text).encode("latin-1", "replace"), np.uint8)[: 2 << 20]
    calls = []
    monkeypatch.setattr(sa, "ON_RECURSION", lambda length, names: calls.append((length, names)))
    order = sa.suffix_array(data)
    assert len(calls) > 3 and calls[0][1] > 10_000 and all(b[0] < a[0] / 2 for a, b in zip(calls, calls[1:], strict=False))
    plcp = sa.permuted_lcp(data, order)
    assert (np.sort(order) == np.arange(len(data))).all()
    # each suffix is larger than the one before it, right behind what they share
    a, b = order[:-1], order[1:]
    n = plcp[b]
    end = np.append(data.astype(np.int16), -1)
    assert (end[np.minimum(a + n, len(data))] < end[np.minimum(b + n, len(data))]).all()


def test_long_runs_are_sorted():
    text = np.concatenate([np.full(30_000, 5), [9], np.full(20_000, 5), [1], np.full(40_000, 7), [3]]).astype(np.uint8)
    order = sa.suffix_array(text)
    plcp = sa.permuted_lcp(text, order)
    a, b = order[:-1], order[1:]
    n, end = plcp[b], np.append(text.astype(np.int16), -1)
    assert (np.sort(order) == np.arange(len(text))).all() and (end[np.minimum(a + n, len(text))] < end[np.minimum(b + n, len(text))]).all()


def brute_spans(rows, size=sd.MIN_BYTES, words=sd.MIN_WORDS):
    """Every window of every document against all windows before it."""
    seen, out = {}, []
    rows = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - size + 1):
            seen.setdefault(raw[p : p + size], (i, p))
    for i, t in rows:
        raw = t.encode()
        covered = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - size + 1):
            if seen[raw[p : p + size]] != (i, p):
                covered[p : p + size] = True
        edge = np.flatnonzero(np.diff(np.append(False, covered).astype(int)))
        space = np.append(True, np.isin(np.frombuffer(raw, np.uint8), [9, 10, 11, 12, 13, 32]))
        begins = np.flatnonzero(~space[1:] & space[:-1])
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            n = int(((begins >= a) & (begins < b)).sum())
            if n >= words:
                out.append((i, int(a), int(b), n, *seen[raw[a : a + size]]))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in sd.repeated_spans(df).drop("uid").collect())


def test_spans_match_brute_force(spark):
    rows = [(int(i), t) for i, t in zip(*sample()[["doc_id", "text"]].values.T, strict=True)]
    want = brute_spans(rows)
    assert want
    assert found(docs(spark, rows)) == want


def test_periodic_and_overlapping_texts_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pool = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(60)) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(pool, rng.integers(1, 4)))) for k in range(40)]
    rows += [(100, "ha " * 400), (101, "ha " * 300), (102, "x" * 5000), (103, "ab ab " * 90 + pool[0])]
    assert found(docs(spark, rows)) == brute_spans(rows)


def test_a_passage_of_many_rows_is_sorted_once_a_flush(spark, monkeypatch):
    passage = " ".join(f"word{k}" for k in range(80))
    rows = [(k, f"{k} {passage}") for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"ua": [k for k, _ in rows], "ub": [1] * len(rows), "doc_id": [k for k, _ in rows], "text": [t for _, t in rows], "starts": [[np.arange(len(t), dtype=np.int32).tobytes()] for _, t in rows]})
    (made,) = sd._segments(1)(iter([batch]))
    sent = {r["shard"]: r for r in made.to_pylist()}
    held = sum(len(t) for _, t in rows)
    assert len(sent[0]["bytes"]) < 3 * held / 100 + 3000 * 200 and len(sent[-1 - 1 % 1]["lens"]) > 4 * 2900
    assert found(docs(spark, rows[:300])) == brute_spans(rows[:300])


@pytest.mark.parametrize("hot", [0, 2_000])
def test_split_anchors_change_nothing(spark, monkeypatch, hot):
    rows = [(int(i), t) for i, t in zip(*sample()[["doc_id", "text"]].values.T, strict=True)]
    rng = np.random.default_rng(4)
    phrase = "licensed under the terms of the licence that stands in the file of that name"
    shared = [" ".join(rng.choice(list("abcdefg"), 3).tolist() * 30) for _ in range(3)]
    rows += [(10_000 + k, f"{' '.join(map(str, rng.integers(0, 9999, 30)))} {shared[k % 3]} {phrase} {shared[k % 2]} {k}") for k in range(60)]
    monkeypatch.setattr(sd, "HOT_BYTES", hot)
    assert found(docs(spark, rows)) == brute_spans(rows)


def test_small_flushes_change_nothing(spark, monkeypatch):
    rows = [(int(i), t) for i, t in zip(*sample()[["doc_id", "text"]].values.T, strict=True)]
    monkeypatch.setattr(sd, "FLUSH_BYTES", 5_000)
    assert found(docs(spark, rows)) == brute_spans(rows)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rows = [(int(i), t) for i, t in zip(*sample()[["doc_id", "text"]].values.T, strict=True)]
    monkeypatch.setattr(sd, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(sd, "ANCHOR_SHARD_BYTES", 30_000)
    assert found(docs(spark, rows)) == brute_spans(rows)


def test_defined_results(spark):
    passage = " ".join(f"wörd{k}" for k in range(70))
    rows = [(1, "é" + passage), (2, "è" + passage + "ü tail"), (3, None), (4, ""), (5, "short"), (None, passage), (6, passage), (6, passage)]
    df = with_clashes(docs(spark, rows))
    out = sd.drop_repeated_spans(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_chars, r.digest) for r in out.collect())
    texts = [(k[1] if not k[0] else None, t, n) for k, t, n, _ in got]
    by = {t[0]: t[1] for t in texts}
    assert by[1] == "é" + passage and by[2] == "èü tail" and by[3] is None and by[6] == "" and by[None] == "" and by[5] == "short"
    assert all(g[3] == "x-digest" for g in got) and set(CLASHES) <= set(out.columns)


def test_empty_table(spark):
    df = docs(spark, [])
    assert sd.repeated_spans(df).count() == 0
    assert sd.drop_repeated_spans(df).collect() == []


def test_a_very_long_text(spark):
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 10**9, 100_000)))
    rows = [(1, text), (2, "head " + text[500_000:503_000] + " tail")]
    (row,) = found(docs(spark, rows))
    assert row[:3] == (2, 5, 3005) and row[4:] == (1, 500_000)
