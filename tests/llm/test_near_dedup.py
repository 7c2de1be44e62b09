from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import common
from pagemill.llm import near_dedup as nd
from pagemill.llm.common import text_bytes
from pagemill.llm.components import components
from tests.llm.helpers import docs, sample, with_clashes


def words(text):
    low = "".join(c.lower() if c.isascii() or c in "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜÆŒ" and len(c.lower()) == 1 and c != "Œ" else c for c in text)
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def shingle_set(text, size=nd.SHINGLE):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, threshold=nd.THRESHOLD):
    texts = sorted({t for _, t in rows if t is not None and words(t)})
    sets = [shingle_set(t) for t in texts]
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    for a, b in {p for ks in by.values() for p in itertools.combinations(ks, 2)}:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            part[max(find(a), find(b))] = min(find(a), find(b))
    return {t: find(k) for k, t in enumerate(texts)}


def brute_kept(rows):
    group = brute_groups(rows)
    best, out = {}, []
    for i, t in rows:
        if t not in group:
            out.append((i, t))
        else:
            best.setdefault(group[t], []).append(((i is None, i or 0), i, t))
    # of a smallest doc_id with several texts any one may stay: compared by id
    return sorted(map(str, [i for i, _ in out] + [min(m, key=lambda x: x[0])[1] for m in best.values()]))


def test_jaccard_is_exact():
    rng = random.Random(1)
    texts = sample()["text"].tolist()[:60] + ["", "one", "one two", "A b c D e", "É è x y"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(200)] + [(t, t.upper().replace(" ", ", ")) for t in texts]
    got = nd.jaccard(*text_bytes(pa.array([a for a, _ in pairs])), *text_bytes(pa.array([b for _, b in pairs])))
    for (a, b), j in zip(pairs, got, strict=True):
        x, y = shingle_set(a), shingle_set(b)
        assert j == pytest.approx(len(x & y) / max(1, len(x | y)))


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    errors = []
    for overlap in (0.2, 0.5, 0.8):
        for _ in range(40):
            h = rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000).astype(np.uint64)
            m = int(1000 * 2 * overlap / (1 + overlap))
            a, b = h[:1000], np.concatenate([h[:m], h[1000 : 2000 - m]])
            regs = [nd.registers(x, np.zeros(1000, np.int64), 1) for x in (a, b)]
            errors.append(nd.estimate(*regs, np.array([1000]), np.array([1000]))[0] - m / (2000 - m))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in part}


@pytest.mark.parametrize("most", [0, 250_000])
def test_rows_that_stay_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (5, 30, 80, 300)]
    rows = [(int(i), t) for i, t in zip(*sample()[["doc_id", "text"]].values.T, strict=True)]
    for k in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(1 + len(w) // 10)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w)))
    rows += [(None, base[3]), (1003, None), (1003, None), (1004, ""), (1005, " ?! "), (1006, " ?! "), (1010, "solo"), (1010, "solo"), (1011, "long " + "x y z " * 40_000)]
    df = with_clashes(docs(spark, rows))
    out = nd.drop_near_repeats(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == brute_kept(rows)
    gone = nd.near_repeats(df).collect()
    assert sum(r.n_rows for r in gone) == len(rows) - len(brute_kept(rows))


def test_empty_table(spark):
    assert nd.drop_near_repeats(docs(spark, [])).collect() == []
    assert nd.near_repeats(docs(spark, [])).collect() == []


def boilerplate_bucket(m, seed=1):
    """Registers of texts that share a fifth of them, with a few near copies among them."""
    rng = np.random.default_rng(seed)
    common = rng.integers(1, 60_000, 128).astype(np.uint16)
    regs = rng.integers(1, 60_000, (m, 128)).astype(np.uint16)
    regs[:, :26] = common[:26]
    for k in range(0, m - 1, 50):
        same = rng.random(128) < rng.choice([0.3, 0.5, 0.8])
        regs[k + 1, same] = regs[k, same]
    regs[rng.random((m, 128)) < 0.05] = 0
    return regs


@pytest.mark.parametrize("m", [2, 40, 60, 700])
def test_pairs_of_a_bucket_equal_all_pairs(m):
    regs, floor = boilerplate_bucket(m), nd.THRESHOLD - nd.SLACK
    part = np.arange(m) % (m - 1)
    n = np.full(m, 300)
    want = {(a, b) for a in range(m) for b in range(a + 1, m) if part[a] != part[b] and nd.estimate(regs[[a]], regs[[b]], n[[a]], n[[b]])[0] >= floor}
    got = set()
    for a, b in nd._apart(regs, part, floor):
        good = nd.estimate(regs[a], regs[b], n[a], n[b]) >= floor
        got |= {(min(x, y), max(x, y)) for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True)}
    assert got == want and (m < 60 or want)


def test_a_large_bucket_of_boilerplate_is_not_compared_pair_by_pair():
    m = 20_000
    regs = boilerplate_bucket(m)
    tested = sum(len(a) for a, _ in nd._apart(regs, np.arange(m), nd.THRESHOLD - nd.SLACK))
    assert tested < 0.02 * m * m / 2
