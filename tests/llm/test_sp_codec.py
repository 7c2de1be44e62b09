from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from pagemill.llm import queries
from pagemill.llm import sp_codec as sc
from pagemill.llm.common import text_bytes
from tests.llm.helpers import docs, sample, with_clashes

HARD = ["ﬁne ½ cup", "éậ x", "ｆｕｌｌ　width", "tab\tnew\nline\r\n", "  two  spaces ", "emoji 😀 ok", "▁ literal", "", "a", " ", "Ǆ ㍍ ﷺ", "κά", "​zero", "\x01ctl", "中文 ﾊﾟ", "…" * 5]


@pytest.fixture(scope="module")
def proto():
    with open(sc.MODEL, "rb") as f:
        return f.read()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normalisation_matches_the_library(proto, rule):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    texts = HARD + sample()["text"].tolist()[:40]
    data, offs = text_bytes(pa.array(texts))
    new, new_offs, lo, hi = sc.normalise(sc.CharMap(sc.charsmap(rule, proto)), data, offs)
    got = [new[a:b].tobytes().decode() for a, b in zip(new_offs[:-1], new_offs[1:], strict=True)]
    assert got == [normaliser.normalize(t) for t in texts]
    assert (lo < hi).all() and (np.diff(lo) >= 0).all()


def brute(charmap, text):
    """Normalisation one character after the other, each output byte with its source."""
    raw, p, out = text.encode(), 0, []
    while p < len(raw):
        n, value = charmap.longest(raw, p, len(raw))
        if n:
            out += [(b, p, p + n) for b in value]
        else:
            n = 1
            while p + n < len(raw) and raw[p + n] & 0xC0 == 0x80:
                n += 1
            out += [(raw[p + k], p + k, p + k + 1) for k in range(n)]
        p += n
    return out


def test_spans_match_brute_force(proto):
    blob = sc.charsmap(sc.RULE, proto)
    charmap = sc.CharMap(blob)
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = HARD + sample()["text"].tolist()[:30]
    ids, starts, ends, offs = sc.encode(proto, blob, *text_bytes(pa.array(texts)))
    for k, text in enumerate(texts):
        norm = brute(charmap, text)
        plain = bytes(b for b, _, _ in norm).decode()
        want = sp.encode(plain)
        assert ids[offs[k] : offs[k + 1]].tolist() == want
        units = [(0, 0)] if norm else []  # the added space, then one unit a normalised byte
        units += [(lo, hi) for _, lo, hi in norm]
        at, spans = 0, []
        for i in want:
            need = [0x20 if c == "▁" else None for c in sp.id_to_piece(i)] if not sp.is_byte(i) else None
            n = 1 if need is None else sum(1 if c == "▁" and (at + j == 0 or norm[at + j - 1][0] == 32) else len(c.encode()) for j, c in enumerate(sp.id_to_piece(i)))
            if need is not None:  # walk the piece byte by byte
                n = 0
                for c in sp.id_to_piece(i):
                    n += 1 if c == "▁" and (at + n == 0 or norm[at + n - 1][0] == 32) else len(c.encode())
            own = [u for u in units[at : at + n] if u != (0, 0) or at + n == 1]
            spans.append((own[0][0], own[-1][1]))
            at += n
        assert at == len(units)
        assert list(zip(starts[offs[k] : offs[k + 1]].tolist(), ends[offs[k] : offs[k + 1]].tolist(), strict=True)) == spans, text


def test_round_trip_and_defined_results(spark, proto):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=sc.RULE, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    texts = [*HARD, None, "long " * 30000, "same", "same"]
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)]
    encoded = sc.encode_docs(with_clashes(docs(spark, rows)))
    by = sorted(map(str, [(r.doc_id, r.ids is None, len(r.ids or []) == len(r.starts or []) == len(r.ends or [])) for r in encoded.collect()]))
    assert by == sorted(map(str, [(i, t is None, True) for i, t in rows]))
    back = sorted(map(str, [(r.doc_id, r.text) for r in sc.decode_docs(encoded).collect()]))
    plain = [(i, None if t is None else normaliser.normalize(t).replace("▁", " ")) for i, t in rows]
    assert back == sorted(map(str, plain))
    assert sc.encode_docs(docs(spark, [])).collect() == []


def test_query_decodes_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=sc.RULE, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    table = sample()
    want = [(i, None if t is None else normaliser.normalize(t).replace("▁", " ")) for i, t in zip(table["doc_id"].tolist(), table["text"].tolist(), strict=True)]
    got = [(r.doc_id, r.decoded) for r in queries.op9_sentencepiece(spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    odd = sc.encode_docs(docs(spark, [(1, None), (2, ""), (3, "ﬁne")]), decoded=True).collect()
    assert sorted((r.doc_id, r.decoded) for r in odd) == [(1, None), (2, ""), (3, "fine")]
