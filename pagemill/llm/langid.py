"""Language identification by prediction by partial matching over bytes.

One context tree of variable order (up to ``order`` preceding bytes; a context stays if it was seen
``min_count`` times) is shared by all languages; each language has its own counts in it. A byte's probability
in a context is c / (n + t) if the language saw it there c times (n bytes, t different ones in that context),
else the escape t / (n + t) times its probability in the next shorter context, where bytes that the longer one knows
are excluded: n and t count the others alone. Contexts that a language never saw cost it nothing, and below the empty
context all bytes left are equally likely, so the probabilities of the 256 bytes sum to one everywhere. Texts are scored under
frozen statistics, so a byte's code length depends on the bytes before it alone: the tree is walked for all
bytes of a block at once, and code lengths are added in fixed point (2**-16 bit), the same in any order.

The statistics come from at most ``docs_per_lang`` whole labelled texts a language, those with the smallest
hash of doc_id; every document is scored whole. The tables that executors hold have a code length for each context, byte and
language: 4 bytes each, and some ten million at 250 texts of each of four languages.

Defined results: a null or empty text, or one whose best code is longer than ``max_bits`` a byte (8: no shorter than the
bytes themselves), is rejected
(language null); ties go to the language that sorts first; equal rows get equal results; null or blank labels
train nothing; without any labelled text everything is rejected; a very long text is scored whole, by itself; an empty table gives an empty result; other
columns are carried along and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_columns, fresh, row_chunks, text_bytes

ORDER, DOCS_PER_LANG, MIN_COUNT, MAX_BITS = 4, 250, 12, 8.0
FIXED = 1 << 16
BLOCK = 1 << 18


@dataclass
class Model:
    langs: list[str]
    order: int
    symbols: np.ndarray  # byte -> symbol; 0 for bytes never seen
    width: int  # symbols, with the last one standing for the start of a text
    child: np.ndarray  # (node * width + older byte) -> node; 1 is the dead end
    cost: np.ndarray  # (node * width + symbol) -> fixed-point bits, a column a language


def padded(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray, order: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with ``order`` start marks before every text, the place of each text's first byte)."""
    n = len(offsets) - 1
    out = np.full(len(data) + order * n, start, np.int32)
    shift = np.repeat(np.arange(1, n + 1) * order, np.diff(offsets))
    out[np.arange(len(data)) + shift] = symbols[data]
    return out, offsets[:-1] + np.arange(1, n + 1) * order


def train(texts: list[str], langs: list[str], order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """Counts over whole texts, frozen into tables of children and code lengths."""
    names = sorted(set(langs))
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    seen = np.unique(np.concatenate(raw)) if raw else np.zeros(0, np.uint8)
    symbols = np.zeros(256, np.int32)
    symbols[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 2
    # per language and order: (context * width + symbol, count); the most recent byte is the context's first digit
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for name in names:
        own = [r for r, l in zip(raw, langs, strict=True) if l == name]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in own])])
        ext, _ = padded(np.concatenate(own), offsets, symbols, order, width - 1)
        ext = ext.astype(np.int64)
        real = np.flatnonzero(ext != width - 1)
        context, each = np.zeros(len(real), np.int64), []
        for d in range(order + 1):
            if d:
                context = context * width + ext[real - d]
            each.append(np.unique(context * width + ext[real], return_counts=True))
        grams.append(each)
    contexts = [np.zeros(1, np.int64)]
    for d in range(1, order + 1):
        total = pd.concat([pd.Series(g[d][1], index=g[d][0] // width) for g in grams]).groupby(level=0).sum()
        kept = total.index.to_numpy()[(total >= min_count).to_numpy()].astype(np.int64)
        kept = kept[np.isin(kept // width, contexts[-1])]
        contexts.append(np.sort(kept))
    first = np.cumsum([0, 2] + [len(c) for c in contexts[1:]])  # node 0 is the empty context, 1 the dead end
    nodes = int(first[-1])
    child = np.ones((nodes, width), np.int32)
    cost = np.zeros((nodes, width, len(names)), np.int32)
    for k, each in enumerate(grams):
        above = whole = below = None  # of the shorter contexts: counts, probabilities, and those of what is left below each
        for d, own in enumerate(contexts):
            counts = np.zeros((len(own), width))
            key, n = each[d]
            at = np.searchsorted(own, key // width).clip(max=max(len(own) - 1, 0))
            hit = (own[at] == key // width) if len(own) else np.zeros(len(key), bool)
            counts[at[hit], key[hit] % width] = n[hit]
            there = counts > 0
            total, kinds = counts.sum(1, keepdims=True), there.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                if not d:
                    left, longer = 1.0 / np.maximum(256 - kinds, 1) * np.ones((1, width)), np.full((1, width), 1 / 256)
                else:
                    parent = np.searchsorted(contexts[d - 1], own // width)
                    outer = np.where(there, 0, above[parent])  # what the longer context knows is excluded
                    rest, new = outer.sum(1, keepdims=True), (outer > 0).sum(1, keepdims=True)
                    escape = np.where(rest + new > 0, new / (rest + new), 1.0)
                    left = np.where(outer > 0, outer / (rest + new), escape * below[parent])
                    longer = whole[parent]
                p = np.where(there, counts / (total + kinds), kinds / (total + kinds) * left)
            seen_here = total > 0
            whole = np.where(seen_here, p, longer)
            below = np.where(seen_here, left, below[parent] if d else left)
            above = np.where(seen_here, counts, above[parent] if d else counts)
            node = first[d] + np.arange(len(own))
            cost[node, :, k] = np.round(-np.log2(whole) * FIXED)
    for d in range(1, order + 1):
        own = contexts[d]
        parent = np.searchsorted(contexts[d - 1], own // width) + first[d - 1]
        child[parent, own % width] = first[d] + np.arange(len(own))
    return Model(names, order, symbols, width, child.reshape(-1), cost.reshape(nodes * width, len(names)))


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact code lengths, texts x languages, in 2**-16 bit."""
    n = len(offsets) - 1
    out = np.zeros((n, len(model.langs)), np.int64)
    w, order = model.width, model.order
    for i, j in row_chunks(offsets, BLOCK):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(part):
            continue
        ext, begin = padded(part, offs, model.symbols, order, w - 1)
        size = len(ext) - order
        node = np.zeros(size, np.int32)
        deepest = node
        for d in range(1, order + 1):
            node = model.child[node * np.int64(w) + ext[order - d : order - d + size]]
            deepest = node if d == 1 else np.where(node == 1, deepest, node)
            if d == 1:
                deepest = np.where(node == 1, 0, node)
        bits = model.cost[deepest * np.int64(w) + ext[order:]]
        bits[ext[order:] == w - 1] = 0
        lo = begin - order
        hi = lo + np.diff(offs)
        for k in range(len(model.langs)):
            sums = np.zeros(size + 1, np.int64)
            np.cumsum(bits[:, k], out=sums[1:])
            out[i:j, k] = sums[hi] - sums[lo]
    return out


def labelled_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> tuple[list[str], list[str]]:
    """At most ``docs_per_lang`` whole texts of each label, by the smallest hash of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter("trim(lang) <> '' and doc_id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= docs_per_lang).select("doc_id", "lang")
    # at most docs_per_lang rows a language, whatever the size of the table
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = picked.filter("length(text) > 0").join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text").distinct().toPandas()
    found = found.sort_values(["lang", "doc_id", "text"]).groupby("lang").head(docs_per_lang)
    return found["text"].tolist(), found["lang"].tolist()


def _fit(docs: DataFrame, order: int, docs_per_lang: int, min_count: int) -> Model | None:
    texts, langs = labelled_sample(docs, docs_per_lang)
    return train(texts, langs, order, min_count) if texts else None


RESULT = "lang string, bits_per_byte double, margin_bits double, accepted boolean"


def _scored(batch: pa.RecordBatch, model: Model | None, max_bits: float, keep: list[str]) -> pa.RecordBatch:
    column = batch.column(batch.schema.get_field_index("text"))
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    bits = (score(model, data, offsets) if model else np.zeros((len(size), 1), np.int64)) / FIXED
    order = np.argsort(bits, axis=1, kind="stable")
    best = order[:, 0]
    at = np.arange(len(size))
    low = bits[at, best]
    margin = (bits[at, order[:, 1]] - low) if bits.shape[1] > 1 else np.zeros(len(size))
    rate = low / np.maximum(size, 1)
    none = (size == 0) | (model is None)
    good = ~none & (rate <= max_bits)
    names = pa.array(model.langs if model else [None], pa.string()).take(pa.array(best))
    made = {
        "lang": pa.compute.if_else(pa.array(good), names, pa.scalar(None, pa.string())),
        "bits_per_byte": pa.array(rate, mask=none), "margin_bits": pa.array(margin, mask=none), "accepted": pa.array(good),
    }
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(made.values()), keep + list(made))


def identify(docs: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG, min_count: int = MIN_COUNT, max_bits: float = MAX_BITS) -> DataFrame:
    """(doc_id, lang, bits_per_byte, margin_bits, accepted) of every row; margin_bits is how much longer the second language's code is."""
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs, order, docs_per_lang, min_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scored(batch, model.value, max_bits, ["doc_id"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, " + RESULT)


def keep_identified(docs: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG, min_count: int = MIN_COUNT, max_bits: float = MAX_BITS) -> DataFrame:
    """``docs``, all columns, without rejected rows and with lang as identified."""
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs, order, docs_per_lang, min_count))
    rest = fresh(docs, "pm_rest")
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias(rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scored(batch, model.value, max_bits, ["text", rest])

    kinds = dict((f.name, f.dataType) for f in docs.schema.fields)
    schema = f"text string, `{rest}` {packed.schema[rest].dataType.simpleString()}, " + RESULT
    good = packed.mapInArrow(run, schema).filter("accepted")
    back = {"text": F.col("text").cast(kinds["text"]), "lang": F.col("lang").cast(kinds["lang"])}
    return good.select(*[(back[c] if c in back else F.col(rest)[c]).alias(c) for c in docs.columns])
