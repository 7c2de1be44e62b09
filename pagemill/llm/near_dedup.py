"""Near-duplicate groups with HyperMinHash.

A text's case-folded words make a set of hashed shingles of ``SHINGLE`` words. Every shingle falls into one of
``BUCKETS`` buckets; a bucket's register of 16 bits keeps its smallest hash in compressed form, six bits of
leading-zero count and ten mantissa bits. Texts that agree in all registers of a band are candidates; the
Jaccard estimate, corrected for chance collisions of compressed registers, drops those far below the
threshold, and the exact Jaccard similarity of the shingle sets decides. Groups are the connected components
of the verified pairs.

Equal texts are one text from the start. In each band bucket every text is first compared to the smallest
one, and only pairs that this leaves in different components are compared to each other, which gives the same
components as all pairs and stays linear when a bucket is full of copies of one text. Of the others, a pair
whose estimate can reach the floor agrees in so many registers that the two share one of the rarest of each
(prefix filtering, which loses nothing): texts are compared only where a rare register brings them together, not
where all of the bucket has the same boilerplate.

Defined results: a null text, or one without any word, is in no group; a text of fewer words than a shingle is
one shingle; of a group the smallest doc_id stays (nulls last, then the smallest digest); rows equal in text
and doc_id count as one document of which one row stays; very long texts are shingled whole, a block of rows or one
text at a time; an empty table gives an empty result; other columns are carried along and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, doc_columns, fold_case, fresh, prefix_hash, row_chunks, span_hash, stored, text_bytes, word_spans
from .components import components

SHINGLE, BUCKETS, MANTISSA, ROWS = 3, 128, 10, 3
THRESHOLD, SLACK = 0.42, 0.15
COLLISION = 0.169919487159739


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of all shingles, repeats included."""
    low = fold_case(data)
    starts, ends, row = word_spans(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = span_hash(prefix_hash(low), starts, ends)
    first = np.searchsorted(row, np.arange(len(offsets)))
    left = first[row + 1] - np.arange(len(row))  # words from here to the end of the text
    total = (first[1:] - first[:-1])[row]
    at = np.flatnonzero((left >= size) | ((total < size) & (left == total)))
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = np.minimum(at + k, len(words) - 1)
        value = value * np.uint64(0x9E3779B97F4A7C15) + np.where(left[at] > k, words[here], np.uint64(k + 1))
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    return value, row[at]


def registers(hashes: np.ndarray, row: np.ndarray, rows: int, buckets: int = BUCKETS) -> np.ndarray:
    """rows x buckets registers; 0 is an empty one. A larger register stands for a smaller hash."""
    out = np.zeros(rows * buckets, np.uint16)
    fraction, exponent = np.frexp((hashes >> np.uint64(12)).astype(np.float64))
    mantissa = np.maximum((2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.int64)
    code = ((53 - exponent.astype(np.int64)) << MANTISSA) | ((1 << MANTISSA) - 1 - mantissa)
    np.maximum.at(out, row * buckets + (hashes & np.uint64(buckets - 1)).astype(np.int64), code.astype(np.uint16))
    return out.reshape(rows, buckets)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard of register rows, less the matches that compression makes by chance, for sets of about n and m shingles."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = COLLISION * a.shape[1] / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same - chance) / np.maximum(used, 1), 0, 1)


def densified(regs: np.ndarray) -> np.ndarray:
    """``regs`` with each empty register filled from another bucket, drawn from the same random sequence for every text, so that a register agrees with the probability of the Jaccard however few shingles there are."""
    out, buckets = regs.copy(), regs.shape[1]
    row, col = np.nonzero((regs == 0) & regs.any(axis=1)[:, None])
    draw = np.random.default_rng(1).integers(0, buckets, (256, buckets))
    for attempt in range(256 + buckets):
        if not len(row):
            break
        source = draw[attempt, col] if attempt < 256 else (col + attempt) % buckets
        found = regs[row, source]
        hit = found > 0
        out[row[hit], col[hit]] = found[hit]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(regs: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row) of the bands of densified registers; a text without shingles has none."""
    regs = densified(regs)
    bands = regs.shape[1] // rows
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    row, band = np.nonzero(parts.any(axis=2))
    return key[row, band], row


def jaccard(a_data: np.ndarray, a_offs: np.ndarray, b_data: np.ndarray, b_offs: np.ndarray) -> np.ndarray:
    """Exact Jaccard of the shingle sets of text pairs."""
    out = np.zeros(len(a_offs) - 1)
    for i, j in row_chunks(a_offs + b_offs):
        parts = []
        for data, offs in ((a_data, a_offs), (b_data, b_offs)):
            hashes, row = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(row), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            parts.append((hashes[new], row[new]))
        hashes = np.concatenate([parts[0][0], parts[1][0]])
        row = np.concatenate([parts[0][1], parts[1][1]])
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        twice = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        both = np.bincount(row[1:][twice], minlength=j - i)
        out[i:j] = both / np.maximum(1, np.bincount(row, minlength=j - i) - both)
    return out


SIGNED = "doc_id long, digest binary, n int, regs binary"


def _digest(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        for i, j in row_chunks(offs):
            hashes, row = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            regs = registers(hashes, row, j - i)
            n = np.bincount(row, minlength=j - i).astype(np.int32)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), j - i, [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), packed], ["doc_id", "digest", "n", "regs"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, regs) of every row whose text has a word."""
    rows = doc_columns(docs).filter("text is not null").withColumn("digest", _digest("text"))
    return rows.mapInArrow(_sign, SIGNED).filter("n > 0")


def _regs(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].view(np.uint16).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            keys, row = band_keys(_regs(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(pa.array(row))], ["key", "node"])


def _estimated(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(k) for k in range(2, 6))
            good = estimate(_regs(a), _regs(b), n.to_numpy(), m.to_numpy()) >= floor
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return run


FEW, PAIRS = 48, 1 << 21


def _apart(regs: np.ndarray, part: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows from different parts, among them all whose estimate can reach ``floor``."""
    m, width = regs.shape
    if m <= FEW:  # all of so few are as soon compared
        a, b = np.triu_indices(m, 1)
        apart = part[a] != part[b]
        yield a[apart], b[apart]
        return
    there = regs > 0
    token = (np.arange(width, dtype=np.int64) << 16) + regs
    _, name, count = np.unique(token[there], return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rarest first
    often = np.sort(count)
    ranked = np.full((m, width), len(count), np.int64)
    ranked[there] = rank[name]
    ranked.sort(axis=1)
    # at least floor * registers of either must agree, so that many of a row's registers, the commonest, can be left out but one
    size = there.sum(axis=1)
    prefix = size - np.maximum(1, np.ceil(floor * size - 1e-9).astype(np.int64)) + 1
    member, column = np.nonzero(np.arange(width) < prefix[:, None])
    key = ranked[member, column]
    shared = often[key] > 1
    member, key = member[shared], key[shared]
    order = np.argsort(key, kind="stable")
    member, key = member[order], key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    end = np.repeat(np.append(head[1:], len(key)), np.diff(np.append(head, len(key))))
    at, step, held, n = np.arange(len(key)), 1, [], 0
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        a, b = member[at], member[at + step]
        apart = part[a] != part[b]
        held.append(a[apart] * m + b[apart])
        n += len(held[-1])
        if n >= PAIRS:
            code = np.unique(np.concatenate(held))
            yield code // m, code % m
            held, n = [], 0
        step += 1
    if n:
        code = np.unique(np.concatenate(held))
        yield code // m, code % m


def _cross(floor: float):
    """Of one band bucket, the pairs from different components that the estimate lets pass."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        node, part, n = (group[c].to_numpy() for c in ("node", "component", "n"))
        regs = _regs(group["regs"])
        left, right = [], []
        for a, b in _apart(regs, part, floor):
            for k in range(0, len(a), 1 << 16):
                i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                good = estimate(regs[i], regs[j], n[i], n[j]) >= floor
                left.append(node[i[good]])
                right.append(node[j[good]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                good = jaccard(*text_bytes(part.column(2)), *text_bytes(part.column(3))) >= threshold
                yield part.filter(pa.array(good)).select(["a", "b"])

    return run


def groups(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """(digest, doc_id, n_rows, kept_doc_id, kept) of every document in a group, by distinct (digest, doc_id); kept marks the one that stays."""
    signed = stored(signatures(docs))
    each = signed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    distinct = signed.select("digest", "n", "regs").dropDuplicates(["digest"])
    # numbered once, as it is written: the numbers are names of texts from here on
    texts = stored(distinct.withColumn("node", F.monotonically_increasing_id()))

    w = Window.partitionBy("key")
    bands = texts.select("node", "regs").mapInArrow(_bands, "key long, node long")
    members = stored(bands.withColumn("leader", F.min("node").over(w)).withColumn("size", F.count(F.lit(1)).over(w)).filter("size > 1").select("key", "node", "leader"))
    tested = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    signs = texts.select("node", "n", "regs")
    of = lambda side: signs.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}"))
    paired = tested.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ra", "rb", "na", "nb")
    likely = stored(paired.mapInArrow(_estimated(threshold - slack), "a long, b long"))

    # the texts of all that share a bucket, gathered once for both rounds
    asked = bounded(stored(members.select("node").distinct().join(texts.select("node", "digest"), "node")))
    found = doc_columns(docs).filter("text is not null").select(_digest("text").alias("digest"), "text").join(asked, "digest").dropDuplicates(["node"])
    held = stored(found.select("node", "text"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: held.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        return stored(both.mapInArrow(_verified(threshold), "a long, b long"))

    edges = verify(likely)
    part = stored(components(edges))
    named = members.select("key", "node").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.withColumn("low", F.min("component").over(w)).withColumn("high", F.max("component").over(w)).filter("low <> high").select("key", "node", "component")
    cross = mixed.join(signs, "node").groupBy("key").applyInArrow(_cross(threshold - slack), "a long, b long").distinct()
    more = verify(stored(cross.join(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")))
    # the components so far are stars already: with the new edges they are soon one again
    stars = part.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    part = stored(components(stars.unionByName(more)))

    grouped = texts.select("node", "digest").join(part, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = each.join(grouped, "digest")
    g = Window.partitionBy("component")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).over(g)
    rows = rows.withColumn("best", best).withColumn("size", F.sum("n_rows").over(g)).filter("size > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    return rows.select("digest", "doc_id", "n_rows", F.col("best.doc_id").alias("kept_doc_id"), kept.alias("kept"))


def near_repeats(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """(doc_id, kept_doc_id, n_rows): n_rows rows of doc_id go because their group keeps kept_doc_id."""
    gone = F.when(F.col("kept"), F.col("n_rows") - 1).otherwise(F.col("n_rows"))
    return groups(docs, threshold, slack).groupBy("doc_id", "kept_doc_id").agg(F.sum(gone).alias("n_rows")).filter("n_rows > 0")


def drop_near_repeats(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """``docs``, all columns, with one row of each group."""
    key, id_, kept = fresh(docs, "pm_digest"), fresh(docs, "pm_id"), fresh(docs, "pm_kept")
    # what goes, and what stays of several equal rows; all else has no mark
    found = stored(groups(docs, threshold, slack).filter(~F.col("kept") | (F.col("n_rows") > 1)))
    marks = bounded(found.select(F.col("digest").alias(key), F.col("doc_id").alias(id_), F.col("kept").alias(kept)))
    keyed = docs.withColumn(key, _digest(F.col("text").cast("string"))).withColumn(id_, F.col("doc_id").cast("long"))
    match = (keyed[key] == marks[key]) & keyed[id_].eqNullSafe(marks[id_])
    joined = keyed.join(marks, match, "left").select(*[keyed[c] for c in keyed.columns], marks[kept])
    out = joined.filter(F.col(kept).isNull()).select(*docs.columns)
    if found.filter("kept").isEmpty():
        return out
    return out.unionByName(joined.filter(F.col(kept)).dropDuplicates([key, id_]).select(*docs.columns))
