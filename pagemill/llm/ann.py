"""Approximate nearest neighbours with balanced posting lists (after SPANN, Chen et al., 2021).

Centroids are fitted by rounds of k-means in which full lists get dearer, so that posting lists stay of about equal
length, on a bounded sample: about ``FIT_PER_LIST`` rows a list, those whose hash falls below a bound. There are
``LISTS * sqrt(rows)`` lists at every size of table, so centroids, list lengths and the sample all grow with the root of
the table, and what a driver or an executor holds of them does too.

Every row is indexed. A vector near a boundary is kept in up to ``COPIES`` lists: those of the nearest centroids that
aren't more than ``1 + COPY_RATIO`` times as far as the nearest. Centroids sit in memory in a graph of their nearest
neighbours, made in blocks on the executors and searched best-first with a beam: a search keeps the nearest
centroids found so far and opens them in turn, and never looks at all of them. Of the lists found, those within ``1 +
PROBE_RATIO`` times the distance of the nearest centroid are read, however many these are, and a least number of
nearest ones in any case. That number is the table's own: ``SAMPLE`` queries are compared to all vectors, and from
``LEAST_LISTS`` on it grows until the lists read hold ``RECALL`` of their k nearest, with all lists as its end.

Lists are dealt to shards of ``SHARD_BYTES``, neighbouring ones together; one that is longer is split over several,
and a query goes once to each shard that holds a list of its. The queries of a shard are split too where they
are more than ``ASK_ROWS``.

Defined results: null or empty vectors, ones with a null or non-finite component, and ones not of the most common
dimension (the smaller on a tie) have no neighbours and are none; equal vectors are neighbours at distance 0, a row is never its own;
neighbours at equal distance are taken by smallest vec_id (nulls last); rows with equal vec_ids are rows of
their own; components are compared relative to the table's largest, so ones 10**38 times smaller count as zero, and a
distance beyond the float range is infinite; a table of fewer than k + 1 vectors gives all the others; an empty one gives
an empty result; other columns are never read. There are no texts here; a very long vector is one like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_bytes

K, LISTS, COPIES, COPY_RATIO, PROBE_RATIO = 10, 2.0, 3, 0.05, 0.1
DEGREE, ROUNDS, PRICE, FIT_PER_LIST = 16, 5, 0.03, 32
SHARD_BYTES, ASK_ROWS = 16 << 20, 100_000
BEAM, OPEN, BLOCK, LEAST_LISTS = 12, 4, 256, 4
RECALL, SAMPLE = 0.95, 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def near_centroids(some: np.ndarray, centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest centroids of some, themselves among them."""
    degree = min(degree, len(centroids))
    return np.argpartition(distances(some, centroids), degree - 1, axis=1)[:, :degree].astype(np.int32)


def centroid_graph(spark: SparkSession, centroids: np.ndarray) -> np.ndarray:
    """Neighbours of every centroid: its nearest ones, compared in blocks on the executors."""
    n, step = len(centroids), 256
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([near_centroids(shared.value[k * step : (k + 1) * step], shared.value).tobytes()], pa.binary())], ["block", "near"])

    blocks = -(-n // step)
    found = spark.range(0, blocks, 1, max(1, min(blocks, spark.sparkContext.defaultParallelism))).mapInArrow(run, "block long, near binary").toArrow()
    order = np.argsort(found["block"].to_numpy())
    near = found["near"].to_pylist()
    return np.frombuffer(b"".join(near[k] for k in order), np.int32).reshape(n, -1)


def starts_of(n: int) -> np.ndarray:
    """Centroids that every search begins from: more of them the more there are, but ever fewer in proportion."""
    return np.unique(np.linspace(0, n - 1, min(n, math.ceil(4 * math.sqrt(n)))).astype(np.int32))


def search_graph(queries: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances), queries x beam, of the nearest centroids that a best-first search finds, nearest first; -1 where there are no more.

    All queries of the block go in step: each opens the nearest ``OPEN`` unopened centroids of its beam and looks at
    their neighbours, of which the nearest come into the beam, until all in it are opened.
    """
    n = len(centroids)
    beam = min(beam, n)
    start = starts_of(n)
    norm, own = (centroids * centroids).sum(1), (queries * queries).sum(1)
    d = own[:, None] + norm[start] - 2 * (queries @ centroids[start].T)
    first = np.argpartition(d, beam - 1, axis=1)[:, :beam] if beam < len(start) else np.broadcast_to(np.arange(len(start)), d.shape)
    ids, far = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), np.inf, np.float32)
    ids[:, : first.shape[1]], far[:, : first.shape[1]] = start[first], np.take_along_axis(d, first, 1)
    opened = ids < 0
    live = np.arange(len(queries))
    for _ in range(n):
        i, f, o = ids[live], far[live], opened[live]
        waiting = np.where(o, np.inf, f)
        pick = np.argpartition(waiting, OPEN - 1, axis=1)[:, :OPEN] if OPEN < beam else np.broadcast_to(np.arange(beam), waiting.shape)
        real = np.isfinite(np.take_along_axis(waiting, pick, 1))
        going = real.any(axis=1)
        if not going.all():
            live, i, f, o, pick, real = live[going], i[going], f[going], o[going], pick[going], real[going]
            if not len(live):
                break
        np.put_along_axis(o, pick, True, 1)
        new = graph[np.take_along_axis(i, pick, 1)]
        new[~real] = -1
        new = new.reshape(len(live), -1)
        q = queries[live]
        d = own[live][:, None] + norm[new] - 2 * np.matmul(centroids[new], q[:, :, None])[:, :, 0]
        i, f, o = np.concatenate([i, new], 1), np.concatenate([f, d], 1), np.concatenate([o, np.zeros(new.shape, bool)], 1)
        # of equal ones the first stays, which knows whether it was opened
        by = np.argsort(i, axis=1, kind="stable")
        i, f, o = (np.take_along_axis(x, by, 1) for x in (i, f, o))
        again = np.zeros(i.shape, bool)
        again[:, 1:] = i[:, 1:] == i[:, :-1]
        gone = again | (i < 0)
        f[gone], i[gone], o[gone] = np.inf, -1, True
        # of equally far ones the smaller stays, so that what has left a beam never comes back
        take = np.argsort(f, axis=1, kind="stable")[:, :beam]
        ids[live], far[live], opened[live] = (np.take_along_axis(x, take, 1) for x in (i, f, o))
    by = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, by, 1), np.sqrt(np.maximum(np.take_along_axis(far, by, 1), 0))


def probed(queries: np.ndarray, centroids: np.ndarray, graph: np.ndarray, least: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the lists to read: the ``least`` nearest, and all within 1 + ratio times the nearest distance."""
    q, at = [], []
    todo, beam = np.arange(len(queries)), min(len(centroids), max(BEAM, least + least // 4 + 1))
    while len(todo):
        ids, far = search_graph(queries[todo], centroids, graph, beam)
        good = (ids >= 0) & ((np.arange(ids.shape[1]) < least) | (far <= far[:, :1] * (1 + ratio)))
        # a beam that the ratio fills to its end may have left some out
        more = good[:, -1] if beam < len(centroids) else np.zeros(len(todo), bool)
        row, col = np.nonzero(good & ~more[:, None])
        q.append(todo[row])
        at.append(ids[row, col])
        todo, beam = todo[more], min(len(centroids), beam * 4)
    return np.concatenate(q or [np.zeros(0, np.int64)]), np.concatenate(at or [np.zeros(0, np.int32)])


def posted(x: np.ndarray, centroids: np.ndarray, graph: np.ndarray, copies: int, copy_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(lists, good), vectors x copies: the lists that each vector is kept in."""
    ids, far = search_graph(x, centroids, graph, max(BEAM, copies))
    ids, far = ids[:, :copies], far[:, :copies]
    return ids, (ids >= 0) & (far <= far[:, :1] * (1 + copy_ratio))


def _matrix(column: pa.Array) -> np.ndarray:
    data, offs = text_bytes(column)
    return data.view(np.float32).reshape(len(offs) - 1, -1) if len(offs) > 1 else np.zeros((0, 1), np.float32)


def _pack(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors, np.float32).tobytes())]).cast(pa.binary())


def _valid(embeddings: DataFrame) -> tuple[DataFrame, int, int, float]:
    """(vec_id, vector) of the usable rows, all components at most 1; how many; their dimension; what 1 stands for."""
    v = F.col("embedding").cast("array<float>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.size("v") > 0).filter(finite)
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("largest")).orderBy(F.desc("n"), "d").first()
    dim, n, top = (found["d"], found["n"], found["largest"]) if found else (1, 0, 1.0)
    scale = 2.0 ** math.frexp(top)[1] if top else 1.0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), _pack(flat.reshape(batch.num_rows, dim))], ["vec_id", "vector"])

    return rows.filter(F.size("v") == dim).mapInArrow(pack, "vec_id long, vector binary"), n, dim, scale


def list_order(centroids: np.ndarray) -> np.ndarray:
    """An order of the lists that keeps neighbours together: halves along the widest direction, again and again."""
    out, todo = [], [np.arange(len(centroids))]
    while todo:
        some = todo.pop()
        if len(some) <= 2:
            out.append(some)
            continue
        x = centroids[some]
        axis = int(x.var(axis=0).argmax())
        half = np.argsort(x[:, axis], kind="stable")
        todo += [some[half[len(some) // 2 :]], some[half[: len(some) // 2]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cluster(vectors: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a table of n vectors, neighbouring ones together: rounds of k-means over the sample, with prices that balance the lists."""
    spark = vectors.sparkSession
    lists = max(1, math.ceil(LISTS * math.sqrt(n)))
    share = min(1.0, FIT_PER_LIST * lists / n)
    drawn = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40)))
    sample = stored(vectors.filter(drawn).select("vec_id", "vector"))
    # as many rows to start from as there are lists, which is the size of the broadcast below too
    first = sample.orderBy(F.xxhash64(F.lit(1), "vec_id", "vector"), "vec_id", "vector").limit(lists).toArrow()
    centroids = _matrix(first["vector"].combine_chunks()).copy()
    lists, price = len(centroids), np.zeros(len(centroids), np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, price))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c, p = shared.value
            total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                step = max(1, (1 << 24) // len(c))
                for i in range(0, len(x), step):
                    # the sample times the lists grow as the table does
                    own = (distances(x[i : i + step], c) + p).argmin(1)
                    count += np.bincount(own, minlength=len(c))
                    np.add.at(total, own, x[i : i + step])
            which = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(which // 256, pa.int64()), pa.array(which, pa.int64()), pa.array(count[which], pa.int64()), pa.array([t.tobytes() for t in total[which]], pa.binary())], ["block", "list", "n", "total"])

        def added(key: tuple, group: pa.Table) -> pa.Table:
            which, own = np.unique(group["list"].to_numpy(), return_inverse=True)
            count = np.bincount(own, group["n"].to_numpy()).astype(np.int64)
            part = np.frombuffer(b"".join(group["total"].to_pylist()), np.float64).reshape(len(own), -1)
            total = np.zeros((len(which), part.shape[1]))
            np.add.at(total, own, part)
            return pa.table({"list": pa.array(which, pa.int64()), "n": pa.array(count, pa.int64()), "mean": _pack((total / count[:, None]).astype(np.float32))})

        parts = sample.select("vector").mapInArrow(sums, "block long, list long, n long, total binary")
        found = parts.groupBy("block").applyInArrow(added, "list long, n long, mean binary").toArrow()
        which, count = found["list"].to_numpy(), np.zeros(lists)
        count[which] = found["n"].to_numpy()
        centroids = centroids.copy()
        centroids[which] = _matrix(found["mean"].combine_chunks())
        spread = float(np.mean((centroids - centroids.mean(0)) ** 2) * centroids.shape[1])
        price = price + PRICE * np.clip(count / count.mean() - 1, -1, 3).astype(np.float32) * np.float32(spread)
    return centroids[list_order(centroids)]


def _exact(vectors: DataFrame, q_rows: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    """(q, lists) of the k nearest others of each of at most SAMPLE queries, by comparison to all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast((q_rows, queries))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        best, other = np.full((len(asked), k), np.inf, np.float32), np.full((len(asked), k), -1, np.int64)
        for batch in batches:
            rows, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for i in range(0, len(x), 4096):
                some = rows[i : i + 4096]
                d = distances(asked, x[i : i + 4096])
                d[own[:, None] == some] = np.inf
                d = np.concatenate([best, d], axis=1)
                who = np.concatenate([other, np.broadcast_to(some, (len(asked), len(some)))], axis=1)
                take = np.argpartition(d, k - 1, axis=1)[:, :k]
                best, other = np.take_along_axis(d, take, 1), np.take_along_axis(who, take, 1)
        q, p = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(other[q, p]), pa.array(best[q, p])], ["q", "row", "distance"])

    w = Window.partitionBy("q").orderBy("distance", "row")
    found = vectors.select("row", "vector").mapInArrow(near, "q int, row long, distance float").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    # k rows for each of the sampled queries
    return vectors.select("row", "lists").join(F.broadcast(found.select("q", "row")), "row").select("q", "lists").toArrow()


def least_lists(index: DataFrame, asked: DataFrame, k: int, centroids: np.ndarray, graph: np.ndarray, probe_ratio: float) -> int:
    """How many nearest lists every query must read at least, so that a sample finds RECALL of its true neighbours."""
    n, least = len(centroids), LEAST_LISTS
    if least >= n:
        return n
    some = asked.orderBy(F.xxhash64("row", F.lit(1)), "row").limit(SAMPLE).select("row", "vector").toArrow()
    queries = _matrix(some["vector"].combine_chunks())
    true = _exact(index, some["row"].to_numpy(), queries, k)
    if not true.num_rows:
        return least
    held = true["lists"].combine_chunks()
    of = true["q"].to_numpy().astype(np.int64)
    which = np.repeat(np.arange(len(of)), pa.compute.list_value_length(held).to_numpy(zero_copy_only=False))
    pair = of[which] * n + held.flatten().to_numpy().astype(np.int64)
    while least < n:
        q, c = probed(queries, centroids, graph, least, probe_ratio)
        if len(np.unique(which[np.isin(pair, q * n + c)])) >= RECALL * len(of):
            break
        least = min(n, least + max(1, least // 6))
    return least


POSTED = "shard int, block int, list int, row long, vec_id long, vector binary"
ASKED = "shard int, block int, row long, lists binary, vector binary"
FOUND = "row long, neighbor_row long, neighbor_id long, distance double"


def _best(q: np.ndarray, p: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (query, vector, distance) the k nearest different vectors of each query."""
    order = np.lexsort((rank[p], d, q))
    q, p, d = q[order], p[order], d[order]
    # a vector that two lists hold stands twice, at one distance
    new = np.append(True, (q[1:] != q[:-1]) | (p[1:] != p[:-1])) if len(q) else np.zeros(0, bool)
    q, p, d = q[new], p[new], d[new]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return q[nth < k], p[nth < k], d[nth < k]


def _search_list(asking: np.ndarray, q_vectors: np.ndarray, own: np.ndarray, vectors: np.ndarray, self_at: np.ndarray, rank: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, vector, squared distance) of the k nearest of the list's vectors ``own`` for each of the queries asking."""
    x = vectors[own]
    slack = 4e-6 * (float((x * x).sum(1).max()) if len(x) else 0)
    for i in range(0, len(asking), BLOCK):
        q = asking[i : i + BLOCK]
        d = distances(q_vectors[q], x)
        d[self_at[q][:, None] == own] = np.inf
        most = min(k, len(own))
        # rounding may put equal ones apart: all that could be among the k go on, and are compared exactly
        cut = np.partition(d, most - 1, axis=1)[:, most - 1 : most] + slack + 4e-6 * (q_vectors[q] ** 2).sum(1)[:, None]
        a, b = np.nonzero((d <= cut) & np.isfinite(d))
        exact = np.empty(len(a))
        for j in range(0, len(a), 16_384):
            step = q_vectors[q[a[j : j + 16_384]]].astype(np.float64) - x[b[j : j + 16_384]]
            exact[j : j + 16_384] = np.einsum("ij,ij->i", step, step)
        yield _best(q[a], own[b], exact, rank, k)


def _search_shard(k: int):
    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        known = ids = np.zeros(0, np.int64)
        q_rows, none = known, np.zeros(0, bool)
        if asked.num_rows and held.num_rows:
            known, first, inverse = np.unique(held["row"].to_numpy(), return_index=True, return_inverse=True)
            vectors = _matrix(held["vector"].combine_chunks())[first]
            ids = held["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()[first]
            none = ~held["vec_id"].is_valid().to_numpy()[first]
            rank = np.argsort(np.lexsort((known, none, ids)))
            lists = held["list"].to_numpy()
            order = np.argsort(lists, kind="stable")
            edge = np.flatnonzero(np.append(True, lists[order][1:] != lists[order][:-1]))
            members = {int(lists[order[a]]): inverse[order[a:b]] for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True)}
            q_rows, q_vectors = asked["row"].to_numpy(), _matrix(asked["vector"].combine_chunks())
            self_at = np.searchsorted(known, q_rows).clip(max=len(known) - 1)
            self_at = np.where(known[self_at] == q_rows, self_at, -1)
            wanted = [np.frombuffer(x, np.int32) for x in asked["lists"].to_pylist()]
            which, who = np.concatenate(wanted), np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
            by = np.argsort(which, kind="stable")
            edge = np.flatnonzero(np.append(True, which[by][1:] != which[by][:-1]))
            size = 0
            for a, b in zip(edge, np.append(edge[1:], len(by)), strict=True):
                own = members.get(int(which[by[a]]))
                if own is not None:
                    for part in _search_list(who[by[a:b]], q_vectors, own, vectors, self_at, rank, k):
                        out.append(part)
                        size += len(part[0])
                if size > 4 * k * len(q_rows) + (1 << 20):
                    out = [_best(*(np.concatenate(x) for x in zip(*out, strict=True)), rank, k)]
                    size = len(out[0][0])
        if not out:
            return pa.table({"row": pa.array([], pa.int64()), "neighbor_row": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        q, p, d = _best(*(np.concatenate(x) for x in zip(*out, strict=True)), rank, k)
        return pa.table({"row": pa.array(q_rows[q], pa.int64()), "neighbor_row": pa.array(known[p], pa.int64()), "neighbor_id": pa.array(ids[p], pa.int64(), mask=none[p]), "distance": pa.array(d)})

    return run


def _units(sizes: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts of each list, its first part, shard of each part): lists in order fill shards of about shard_rows, a longer list several."""
    parts = np.maximum(1, -(-sizes // shard_rows))
    first = np.cumsum(parts) - parts
    each = np.repeat(sizes / parts, parts)
    return parts, first, ((np.cumsum(each) - each / 2) // shard_rows).astype(np.int64)


def _counts(rows: DataFrame, n: int) -> np.ndarray:
    """How often each of n lists stands in the column lists."""
    found = rows.select(F.explode("lists").alias("list")).groupBy("list").count().toArrow()
    out = np.zeros(n, np.int64)
    out[found["list"].to_numpy()] = found["count"].to_numpy()
    return out


def neighbours(embeddings: DataFrame, k: int = K, queries: Column | None = None, copies: int = COPIES, copy_ratio: float = COPY_RATIO, probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance) of the k nearest others, among all rows, of every row, or of those whose vec_id fulfils ``queries``."""
    spark = embeddings.sparkSession
    vectors, n, dim, scale = _valid(embeddings)
    if not n:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance float")
    centroids = cluster(vectors, n)
    lists = len(centroids)
    shared = spark.sparkContext.broadcast((centroids, centroid_graph(spark, centroids)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for i in range(0, len(x), BLOCK):
                at, good = posted(x[i : i + BLOCK], *shared.value, copies, copy_ratio)
                offsets = np.append(0, np.cumsum(good.sum(1))).astype(np.int32)
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[good], pa.int32()))], ["vec_id", "vector", "lists"])

    # stored: rows are numbered once, as they are written
    index = stored(vectors.mapInArrow(post, "vec_id long, vector binary, lists array<int>").withColumn("row", F.monotonically_increasing_id()))
    chosen = index.select("row", "vec_id", "vector") if queries is None else index.filter(queries).select("row", "vec_id", "vector")
    least = least_lists(index, chosen, k, centroids, shared.value[1], probe_ratio)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for i in range(0, len(x), BLOCK):
                q, at = probed(x[i : i + BLOCK], *shared.value, least, probe_ratio)
                order = np.lexsort((at, q))
                offsets = np.searchsorted(q[order], np.arange(min(BLOCK, len(x) - i) + 1)).astype(np.int32)
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order], pa.int32()))], ["row", "vector", "lists"])

    asked = stored(chosen.select("row", "vector").mapInArrow(ask, "row long, vector binary, lists array<int>"))
    sizes, asks = _counts(index, lists), _counts(asked, lists)
    parts, first, shard_of = _units(sizes, max(1, SHARD_BYTES // (4 * dim + 40)))
    owner = np.repeat(np.arange(lists), parts)
    # at most as many queries come to a shard as ask for its lists
    blocks = np.maximum(1, -(-np.bincount(shard_of, asks[owner]).astype(np.int64) // ASK_ROWS))
    deal = spark.sparkContext.broadcast((parts, first, shard_of, blocks))

    def post_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, shard_of, blocks = deal.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                at = part.column(3).flatten().to_numpy()
                who = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column(3)).to_numpy(zero_copy_only=False))
                shard = shard_of[first[at] + part.column(0).to_numpy()[who] % parts[at]]
                times = blocks[shard]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, who, shard = np.repeat(at, times), np.repeat(who, times), np.repeat(shard, times)
                some = part.select([0, 1, 2]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int32()), pa.array(at, pa.int32()), *some.columns], ["shard", "block", "list", "row", "vec_id", "vector"])

    def ask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, shard_of, blocks = deal.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                at = part.column(2).flatten().to_numpy()
                who = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
                size = parts[at]
                unit = np.repeat(first[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                who, at, shard = np.repeat(who, size), np.repeat(at, size), shard_of[unit]
                order = np.lexsort((at, shard, who))
                who, at, shard = who[order], at[order].astype(np.int32), shard[order]
                head = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (shard[1:] != shard[:-1]))) if len(who) else np.zeros(0, np.int64)
                some = part.select([0, 1]).take(pa.array(who[head]))
                block = some.column(0).to_numpy() // 7 % blocks[shard[head]]
                names = [np.unique(x).tobytes() for x in np.split(at, head[1:])] if len(head) else []
                yield pa.RecordBatch.from_arrays([pa.array(shard[head], pa.int32()), pa.array(block, pa.int32()), some.column(0), pa.array(names, pa.binary()), some.column(1)], ["shard", "block", "row", "lists", "vector"])

    held = index.select("row", "vec_id", "vector", "lists").mapInArrow(post_rows, POSTED)
    wanted = asked.select("row", "vector", "lists").mapInArrow(ask_rows, ASKED)
    found = wanted.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(_search_shard(k), FOUND)
    # a boundary vector may come from two shards
    once = found.groupBy("row", "neighbor_row").agg(F.min("distance").alias("distance"), F.first("neighbor_id").alias("neighbor_id"))
    w = Window.partitionBy("row").orderBy("distance", F.asc_nulls_last("neighbor_id"), "neighbor_row")
    best = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    distance = (F.sqrt("distance") * F.lit(scale)).cast("float").alias("distance")
    return best.join(chosen.select("row", "vec_id"), "row").select("vec_id", "rank", "neighbor_id", distance)
