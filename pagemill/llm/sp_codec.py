"""SentencePiece encoding that keeps the bytes each piece came from, and decoding.

Normalisation takes, at every character, the longest key of the compiled character map (a double-array trie
followed by the replacements, as stored in SentencePiece models) that the text goes on with. Every normalised
byte remembers the source bytes it stands for: its own if nothing was replaced, the whole key if something was.
The pieces of an encoding tile the normalised text, so the lengths of their bytes give their places in it, and
these lead back to original byte spans. A piece that holds part of a replacement gets the whole of its source,
so neighbours can share source bytes but none is empty, except for the space put before the first word.

Keys are looked for in all positions of a block at once, by their first three bytes; only the few positions
that pass are walked through the trie.

Defined results: a null text has null arrays; an empty one has empty ones; a very long one is encoded whole, by itself; equal rows get equal results; an
empty table gives an empty result; other columns are never read. The model must have byte pieces for what it
lacks, as unknown pieces have no length of their own.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, row_chunks, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RULE = "nmt_nfkc"
BLOCK = 1 << 19


class CharMap:
    """A compiled character map: replacement of the longest key that a text starts with."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size :]
        self.first = np.zeros(1 << 24, bool)  # three bytes that can begin a key
        if blob:
            self._mark(b"", 0)

    def _child(self, at: int, byte: int) -> int:
        unit = self.units[at]
        at ^= (unit >> 10) << ((unit & 0x200) >> 6) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    def _mark(self, prefix: bytes, at: int) -> None:
        code = int.from_bytes(prefix.ljust(3, b"\0"), "big")
        if len(prefix) == 3:
            self.first[code] = True
            return
        if prefix and self.units[at] >> 8 & 1:
            self.first[code : code + (1 << 8 * (3 - len(prefix)))] = True
        for byte in range(1, 256):
            child = self._child(at, byte)
            if child >= 0:
                self._mark(prefix + bytes([byte]), child)

    def longest(self, text: bytes, start: int, end: int) -> tuple[int, bytes]:
        """(length of the longest key at ``start``, its replacement); length 0 if there is none."""
        at, found, value = 0, 0, b""
        for k in range(start, end):
            at = self._child(at, text[k])
            if at < 0:
                break
            unit = self.units[at]
            if unit >> 8 & 1:
                leaf = self.units[at ^ ((unit >> 10) << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                found, value = k + 1 - start, self.values[leaf : self.values.index(b"\0", leaf)]
        return found, value


def normalise(charmap: CharMap | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, source starts, source ends) of normalised texts; sources count from data[0]."""
    n = len(data)
    at = np.arange(n)
    if charmap is None or not n:
        return data, offsets, at, at + 1
    wide = np.append(data, np.zeros(2, np.uint8)).astype(np.int32)
    maybe = np.flatnonzero(charmap.first[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]] & ((data & 0xC0) != 0x80))
    ends = offsets[np.searchsorted(offsets, maybe, side="right")]
    raw, edits, reached = data.tobytes(), [], 0
    single: dict[bytes, tuple[int, bytes]] = {}
    for p, end in zip(maybe.tolist(), ends.tolist(), strict=True):
        if p < reached:
            continue
        around = raw[p : min(p + 24, end)]
        got = single.get(around[:1]) if around[0] < 32 else None  # control characters begin no longer key
        if got is None:
            got = charmap.longest(raw, p, end)
            if around[0] < 32 and got[0] == 1:
                single[around[:1]] = got
        length, value = got
        if length:
            edits.append((p, length, value))
            reached = p + length
    if not edits:
        return data, offsets, at, at + 1
    place = np.array([e[0] for e in edits])
    length = np.array([e[1] for e in edits])
    size = np.array([len(e[2]) for e in edits])
    # how many output bytes each source byte makes: one, or at a key's first byte its replacement and none after it
    count = np.ones(n, np.int64)
    inside = np.repeat(place, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    count[inside] = 0
    count[place] = size
    out_at = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(at, count)
    stop = source + 1
    new = data[source]
    put = np.repeat(out_at[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    new[put] = np.frombuffer(b"".join(e[2] for e in edits), np.uint8)
    stop[put] = np.repeat(place + length, size)
    return new, out_at[offsets], source, stop


@cache
def _model(proto: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    size = np.zeros(sp.get_piece_size(), np.int64)
    for k in range(len(size)):
        size[k] = 1 if sp.is_byte(k) else len(sp.id_to_piece(k).encode())
    if not any(map(sp.is_byte, range(len(size)))):
        raise ValueError("the model has no byte pieces")
    return sp, size


@cache
def _charmap(blob: bytes) -> CharMap | None:
    return CharMap(blob) if blob else None


def charsmap(rule: str | None, proto: bytes) -> bytes:
    """The compiled map of a named rule (nmt_nfkc, nfkc, nmt_nfkc_cf, ...), or the model's own if there is no name."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto() if rule else proto)
    return model.normalizer_spec.precompiled_charsmap


def encode(proto: bytes, blob: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends, offsets of the texts in them); starts and ends are bytes of the original text."""
    sp, size = _model(proto)
    new, new_offs, lo, hi = normalise(_charmap(blob), data, offsets)
    raw = new.tobytes()
    texts = [raw[a:b].decode() for a, b in itertools.pairwise(new_offs.tolist())]
    lists = sp.encode(texts, num_threads=1)
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, counts.sum())
    token_offs = np.concatenate([[0], np.cumsum(counts)])
    # the encoder sees a space of three bytes before every text, and each space as three bytes
    filled = np.diff(new_offs) > 0
    weight = np.where(new == 32, 3, 1)
    width = np.concatenate([[0], np.cumsum(weight)])
    begin = width[new_offs[:-1]] + 3 * (np.cumsum(filled) - filled)  # where each text begins among the encoder's bytes
    index = np.repeat(np.arange(len(new)), weight)
    head = begin[filled]
    source = np.full(len(index) + 3 * len(head), -1, np.int64)
    skip = np.ones(len(source), bool)
    skip[(head[:, None] + np.arange(3)).ravel()] = False
    source[skip] = index
    length = size[ids]
    stop = np.cumsum(length)
    if len(source) != (stop[-1] if len(stop) else 0):
        raise ValueError("the pieces don't tile the normalised text")
    first, last = source[stop - length], source[stop - 1]
    row = np.repeat(np.arange(len(counts)), counts)
    base = offsets[:-1][row]
    # a piece that begins with the added space begins with the text's first byte
    inner = first < 0
    follow = np.where(inner & (last >= 0), new_offs[:-1][row], first)
    starts = np.where(follow >= 0, lo[np.maximum(follow, 0)] - base, 0) if len(ids) else np.zeros(0, np.int64)
    ends = np.where(last >= 0, hi[np.maximum(last, 0)] - base, 0) if len(ids) else np.zeros(0, np.int64)
    return ids, starts.astype(np.int32), ends.astype(np.int32), token_offs


def decode(proto: bytes, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The normalised texts of ids; ``offsets`` are those of the texts in them."""
    sp, _ = _model(proto)
    return [sp.decode(ids[a:b].tolist()) for a, b in itertools.pairwise(offsets.tolist())]


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode_docs(docs: DataFrame, model: str = MODEL, rule: str | None = RULE, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, starts, ends): the pieces of every text and the original bytes that each stands for; with ``decoded`` also the text that the ids give."""
    with open(model, "rb") as f:
        proto = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((proto, charsmap(rule, proto)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, blob = shared.value
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            null = ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, j in row_chunks(offs, BLOCK):
                ids, starts, ends, token_offs = encode(proto, blob, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lists = pa.array(token_offs.astype(np.int32), pa.int32(), mask=np.append(null[i:j], False))
                arrays = [pa.ListArray.from_arrays(lists, pa.array(x, pa.int32())) for x in (ids, starts, ends)]
                names = ["doc_id", "ids", "starts", "ends"]
                if decoded:
                    arrays.append(pa.array(decode(proto, ids, token_offs), pa.string(), mask=null[i:j]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays], names)

    return doc_columns(docs).mapInArrow(run, ENCODED + (", decoded string" if decoded else ""))


def decode_docs(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids, ...): the normalised texts; null ids give a null text."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else sp.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
