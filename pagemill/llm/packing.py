"""Best-fit packing of documents into training sequences by a configuration linear program.

A text's length is its number of UTF-8 bytes (a byte-level vocabulary; any other length column can be named).
Texts longer than ``capacity`` are cut into pieces of that length and a rest. The histogram of piece lengths,
rounded up to a grain of at least ``capacity / CLASSES``, is the only thing that leaves the cluster: at most ``CLASSES`` numbers
whatever the input. On it the configuration program (as few bins as possible, each filled by one
configuration of lengths, all pieces covered) is solved by multiplicative weights: in every round an
unbounded-knapsack dynamic program finds the configuration worth most under the classes' weights, and the
classes it covers lose weight. The fractional solution is rounded down, what remains is filled best-fit, again
by the knapsack, and the resulting list of (configuration, number of bins) is dealt to the pieces by their rank
within their length class.

Defined results: a null or empty text has no piece and appears once, without a bin; rows equal in every column
are packed each for itself; ties in a class are dealt in the order of doc_id and text; an empty table gives an
empty result; a very long text makes as many pieces as it needs; a capacity that isn't a multiple of its grain is used
down to the last whole grain, so no bin is ever over it, and one below ``classes`` has a class for each length; a
capacity or number of classes below 1, or a negative length, is an error; other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY, CLASSES, ROUNDS, STEP = 32768, 256, 1200, 0.3
RANK_ROWS = 50_000


def knapsack(values: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """The most valuable configuration of total size at most len(values): how often each size 1..n is in it. With ``limit``, at most so often."""
    n = len(values)
    if limit is None:
        best, choice = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        for c in range(1, n + 1):
            gain = best[c - 1 :: -1][:c] + values[:c]  # size s leaves c - s
            k = int(gain.argmax())
            if gain[k] > best[c - 1]:
                best[c], choice[c] = gain[k], k + 1
            else:
                best[c] = best[c - 1]
        used, c = np.zeros(n, np.int64), n
        while c > 0:
            if choice[c]:
                used[choice[c] - 1] += 1
                c -= choice[c]
            else:
                c -= 1
        return used
    items: list[tuple[int, int]] = []  # (size, copies), copies in powers of two
    for s in np.flatnonzero(limit > 0) + 1:
        left, k = int(min(limit[s - 1], n // s)), 1
        while left:
            take = min(k, left)
            items.append((int(s), take))
            left -= take
            k *= 2
    best, took = np.zeros(n + 1), np.zeros((len(items), n + 1), bool)
    for i, (s, k) in enumerate(items):
        size = s * k
        if size <= n:
            gain = best[: n + 1 - size] + values[s - 1] * k
            took[i, size:] = gain > best[size:]
            best[size:] = np.where(took[i, size:], gain, best[size:])
    used, c = np.zeros(n, np.int64), int(best.argmax())
    for i in range(len(items) - 1, -1, -1):
        if took[i, c]:
            used[items[i][0] - 1] += items[i][1]
            c -= items[i][0] * items[i][1]
    return used


def solve(counts: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional configurations that cover ``counts`` (of sizes 1..n), and a lower bound on any cover.

    Covering by multiplicative weights: the weights are a dual price, and prices under which no configuration
    is worth more than one prove that at least sum(price * count) bins are needed.
    """
    there = counts > 0
    if not there.any():
        return {}, 0.0
    need = np.where(there, counts, 1).astype(float)
    log_weight = np.log(need * np.arange(1, len(counts) + 1))  # every piece priced by its length, to begin with
    total: dict[tuple[int, ...], float] = {}
    covered, bound = np.zeros(len(counts)), 0.0
    for _ in range(rounds):
        weight = np.where(there, np.exp(log_weight - log_weight[there].max()), 0.0)
        price = weight / need
        used = knapsack(price)
        worth = float((price * used).sum())
        bound = max(bound, float(weight.sum()) / worth)
        share = np.where(used > 0, used / need, 0.0)
        amount = 1.0 / share.max()  # bins until its scarcest class would be covered
        key = tuple(used.tolist())
        total[key] = total.get(key, 0.0) + amount
        covered += share * amount
        log_weight -= step * share * amount
    scale = covered[there].min()
    if scale <= 0:  # a class that was never worth a place: a bin for each of its fill
        for s in np.flatnonzero(there & (covered <= 0)):
            used = np.zeros(len(counts), np.int64)
            used[s] = len(counts) // (s + 1)
            total[tuple(used.tolist())] = counts[s] / used[s]
            covered[s] = 1.0
        scale = covered[there].min()
    return {k: v / scale for k, v in total.items()}, bound


def plan(counts: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Whole bins, as (configuration, number), that hold exactly ``counts`` pieces of sizes 1..n; and the lower bound."""
    fractional, bound = solve(counts, rounds, step)
    left, out = counts.astype(np.int64).copy(), []

    def add(used: np.ndarray, most: float) -> None:
        on = used > 0
        bins = int(min(most, (left[on] // used[on]).min()))
        if bins > 0:
            out.append((used, bins))
            left[on] -= bins * used[on]

    for key, bins in sorted(fractional.items(), key=lambda x: (-x[1], x[0])):
        add(np.array(key, np.int64), np.floor(bins))
    size = np.arange(1, len(counts) + 1, dtype=float)
    while left.any():
        # the fullest bin; of equally full ones that with fewer, larger pieces
        add(knapsack(np.where(left > 0, size - 1e-6, 0.0), left), np.inf)
    return out, bound


def _pieces(docs: DataFrame, capacity: int, length: Column | None) -> DataFrame:
    text = F.col("text").cast("string")
    whole = F.coalesce((F.octet_length(text) if length is None else length).cast("long"), F.lit(0))
    whole = F.when(whole >= 0, whole).otherwise(F.raise_error(F.lit("a negative length")).cast("long"))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), whole.alias("whole"))
    each = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)))))
    return each.select("doc_id", "tie", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("long").alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("int").alias("length"))


def _dealt(spark: SparkSession, bins: list[tuple[np.ndarray, int]], classes: int) -> DataFrame:
    """(class, lo, per_bin, first_bin): ranks from lo on go per_bin to a bin from first_bin on. At most classes * configurations rows."""
    rows, taken, first = [], np.zeros(classes, np.int64), 0
    for used, number in bins:
        for s in np.flatnonzero(used):
            rows.append((int(s) + 1, int(taken[s]), int(taken[s] + used[s] * number), int(used[s]), first))
            taken[s] += used[s] * number
        first += number
    return spark.createDataFrame(rows, "class int, lo long, hi long, per_bin int, first_bin long")


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, rounds: int = ROUNDS, step: float = STEP, length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin): each piece of every document, and the bin that it goes to."""
    if capacity < 1 or classes < 1:
        raise ValueError("capacity and classes must be at least 1")
    spark = docs.sparkSession
    grain = -(-capacity // classes)
    classes = capacity // grain  # all that fits is a whole number of grains
    capacity = classes * grain
    # stored: ranks and plan must come from one and the same set of rows
    pieces = stored(_pieces(docs, capacity, length).withColumn("class", F.ceil(F.col("length") / grain).cast("int")))
    histogram = pieces.filter("length > 0").groupBy("class").count().collect()
    counts = np.zeros(classes, np.int64)
    for row in histogram:
        counts[row["class"] - 1] = row["count"]
    # a class is ranked in parts of its own, and what the parts before hold is added
    parts = max(1, -(-int(counts.sum()) // RANK_ROWS))
    packed = pieces.filter("length > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("int"))
    sizes = packed.groupBy("class", "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("class", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "tie", "piece")) - 1
    ranked = packed.withColumn("own", own).join(offsets, ["class", "part"]).withColumn("rank", F.col("own") + F.col("offset"))
    bins, _ = plan(counts, rounds, step)
    # bounded by the number of classes and configurations, whatever the input
    dealt = F.broadcast(_dealt(spark, bins, classes))
    place = (ranked["class"] == dealt["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    bin_ = (F.col("first_bin") + F.floor((F.col("rank") - F.col("lo")) / F.col("per_bin"))).cast("long")
    full = ranked.join(dealt, place).select("doc_id", "piece", "start", "length", bin_.alias("bin"))
    return full.unionByName(pieces.filter("length = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("long").alias("bin")))
