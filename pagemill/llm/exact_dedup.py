"""Exact deduplication against a minimal perfect hash over historical digests.

``build_index`` keeps one winner (smallest doc_id) for every distinct SHA-256 of a history, split into
shards by digest. Each shard is one row: the bit arrays of a minimal perfect hash (levels of bit arrays in
which a key owns a bit that no other key of its level asks for; a key's slot is that bit's rank), and slots
that hold the whole digest and the winner's locator. ``lookup`` hashes incoming digests to slots, compares
all 32 bytes, and so tells members from nonmembers, which a perfect hash alone can't. Nonmembers are grouped
among themselves. Lookups are made once per distinct digest, so a text with millions of copies costs as
much as any other.

Defined results: a null text is never a repeat and stays; an empty text is a text like any other; of equal
texts the smallest doc_id stays (a null doc_id only when all are null); of rows equal in text and doc_id one
stays; a very long text is digested in the JVM like any other; an empty table gives an empty result; other columns are
carried along and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, mix64, stored

INDEX_SCHEMA = "shard int, n long, sizes array<long>, bits binary, slots binary, locators binary, valid binary"
PER_SHARD = 200_000
GAMMA = 2.0


def _level_hash(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place of its own at every level, from all 32 bytes, so that only equal digests meet at each."""
    salt = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(4 * level))
    out = np.zeros(len(digests), np.uint64)
    for k in range(4):
        out = mix64(out ^ digests[:, k] ^ salt[k])
    return (out % np.uint64(size)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sizes of the levels, their bits in a row) of a minimal perfect hash over distinct 32-byte digests, given as n x 4 uint64."""
    left, sizes, parts, level = digests, [], [], 0
    while len(left):
        size = max(64, int(len(left) * GAMMA))
        at = _level_hash(left, level, size)
        bits = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(bits)
        left = left[~bits[at]]
        level += 1
        if level > 200:
            raise ValueError("a digest stands twice")
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def mph_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of every digest; for a nonmember any slot, or -1."""
    ranks = np.concatenate([[0], np.cumsum(bits)])
    out, todo, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + _level_hash(digests[todo], level, size)
        hit = bits[at]
        out[todo[hit]] = ranks[at[hit]]
        todo = todo[~hit]
        base += size
        if not len(todo):
            break
    return out


def _digest_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _int_column(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_valid().to_numpy().astype(bool)


def _build_shard(key: tuple, group: pa.Table) -> pa.Table:
    digests = _digest_array(group["digest"])
    ids, valid = _int_column(group["doc_id"])
    sizes, bits = build_mph(digests)
    order = np.empty(len(ids), np.int64)
    order[mph_slots(digests, sizes, bits)] = np.arange(len(ids))
    row = {
        "shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "slots": pa.array([digests[order].tobytes()], pa.binary()),
        "locators": pa.array([ids[order].tobytes()], pa.binary()), "valid": pa.array([valid[order].tobytes()], pa.binary()),
    }
    return pa.table(row)


def _lookup_shard(key: tuple, asked: pa.Table, index: pa.Table) -> pa.Table:
    digests = _digest_array(asked["digest"])
    member = np.zeros(len(digests), bool)
    winner, valid = np.zeros(len(digests), np.int64), np.zeros(len(digests), bool)
    if index.num_rows and len(digests):
        row = index.slice(0, 1).to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
        at = mph_slots(digests, row["sizes"], bits)
        slots = np.frombuffer(row["slots"], np.uint64).reshape(-1, 4)
        member = (at >= 0) & (slots[at] == digests).all(axis=1)
        winner = np.frombuffer(row["locators"], np.int64)[at]
        valid = np.frombuffer(row["valid"], bool)[at] & member
    out = asked.select(["digest", "n", "least", "again"])
    return out.append_column("member", pa.array(member)).append_column("winner", pa.array(winner, mask=~valid))


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id")).filter("digest is not null")


def _distinct(docs: DataFrame) -> DataFrame:
    """(digest, n, doc_id, again): rows of a text, their smallest doc_id, and whether several rows have that one."""
    each = _digests(docs).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows"))
    found = each.groupBy("digest").agg(F.sum("rows").alias("n"), least.alias("least"))
    return found.select("digest", "n", F.col("least.doc_id").alias("doc_id"), (F.col("least.rows") > 1).alias("again"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """The index of a history (doc_id, text, ...), written to the shared folder, and its number of shards, which grows with the distinct digests."""
    found = stored(_distinct(history))
    shards = max(1, -(-found.count() // per_shard))
    rows = found.select(_shard(shards), "digest", "doc_id").groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA)
    return stored(rows), shards


def lookup(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, n, least, again, member, winner) of each distinct digest of ``docs``: n rows have it, least is their smallest doc_id (again: of several rows); a nonmember's winner is null."""
    asked = _distinct(docs).withColumnRenamed("doc_id", "least").select(_shard(shards), "digest", "n", "least", "again")
    schema = "digest binary, n long, least long, again boolean, member boolean, winner long"
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_lookup_shard, schema)


def winners(docs: DataFrame, history: DataFrame | None = None, inside: bool = False) -> DataFrame:
    """(digest, member, winner, again) of the digests that lose a row: those with a winner in the history, and repeated ones that aren't in it, which take their own smallest doc_id.

    Without a history the table is its own: every digest is a member, and its winner is one of its rows. With ``inside`` the
    history is the part of the table with the smaller doc_ids, so a winner in it is one of the table's rows as well.
    """
    index, shards = build_index(docs if history is None else history)
    found = lookup(docs, index, shards).filter(F.col("member") | (F.col("n") > 1))
    own = F.lit(history is not None and not inside) & F.col("member")
    return found.filter(own | (F.col("n") > 1)).select("digest", own.alias("member"), F.when(F.col("member"), F.col("winner")).otherwise(F.col("least")).alias("winner"), "again")


def exact_repeats(docs: DataFrame, history: DataFrame | None = None, inside: bool = False) -> DataFrame:
    """(doc_id, kept_doc_id, n_rows): n_rows rows of doc_id go because kept_doc_id has the same text."""
    each = _digests(docs).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    gone = F.when(~F.col("member") & F.col("doc_id").eqNullSafe(F.col("winner")), F.col("n") - 1).otherwise(F.col("n"))
    return each.join(winners(docs, history, inside), "digest").select("doc_id", F.col("winner").alias("kept_doc_id"), gone.alias("n_rows")).filter("n_rows > 0")


def earlier_half(docs: DataFrame) -> DataFrame:
    """The rows with the smaller doc_ids, up to the middle of their range: what an incremental run would have as history."""
    id_ = F.col("doc_id").cast("long")
    middle = docs.agg((F.min(id_) / 2 + F.max(id_) / 2).alias("x")).first()["x"]
    return docs.filter(id_ <= F.lit(middle))


def drop_exact_repeats(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, without the rows that exact_repeats counts."""
    key, mark = fresh(docs, "pm_digest"), fresh(docs, "pm_winner")
    found = stored(winners(docs, history))
    lost = bounded(found.select(F.col("digest").alias(key), F.struct("member", "winner", "again").alias(mark)))
    joined = docs.withColumn(key, F.unhex(F.sha2(F.col("text").cast("string"), 256))).join(lost, key, "left")
    first = ~F.col(f"{mark}.member") & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}.winner"))
    out = joined.filter(F.col(mark).isNull() | (first & ~F.col(f"{mark}.again"))).select(*docs.columns)
    if found.filter("again and not member").isEmpty():
        return out
    return out.unionByName(joined.filter(first & F.col(f"{mark}.again")).dropDuplicates([key]).select(*docs.columns))
