from __future__ import annotations

import random

import regex

from pagemill.llm import license_scan as ls
from tests.llm.helpers import docs, with_clashes


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        move = rng.randrange(3)
        if move == 0:
            chars[k] = rng.choice("qzx")
        elif move == 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("qzx"))
    return "".join(chars)


def brute(text):
    """The bounded-error expression of every notice over the whole text, without seeds."""
    low, out = ls.fold(text), []
    for k, (_, pattern) in enumerate(ls.NOTICES):
        errors = ls.allowed(pattern, ls.MAX_ERRORS)
        for m in regex.finditer(f"(?e)(?:{regex.escape(ls.fold(pattern), literal_spaces=True)}){{e<={errors}}}", low):
            out.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
    return ls.best_apart(out)


def test_scan_matches_brute_force():
    rng = random.Random(5)
    scanner = ls.Scanner(tuple((n, ls.fold(p)) for n, p in ls.NOTICES), ls.MAX_ERRORS)
    built = scanner.build()
    hits = 0
    for _ in range(120):
        words = [rng.choice(["lorem", "ipsum", "license", "the", "Übung", "rights", "under"]) for _ in range(30)]
        for _ in range(rng.randrange(3)):
            _, pattern = rng.choice(ls.NOTICES)
            words.insert(rng.randrange(len(words)), edited(rng, pattern.title(), rng.randrange(5)))
        text = " ".join(words)
        got = scanner.scan(*built, text)
        hits += len(got)
        assert got == brute(text), text
    assert hits > 60


def test_query_and_defined_results(spark):
    rows = [(1, "x " * 20000 + "Licensed under the Apachee License, Version 2.0 end"), (2, None), (3, ""), (None, "ALL RIGHTS RESERVED"), (5, "nothing here"), (5, "released under the MIT license. Released under the MIT License"), (5, "released under the MIT license. Released under the MIT License")]
    got = sorted(map(str, map(tuple, ls.notices(with_clashes(docs(spark, rows))).collect())))
    want = [(1, "Apache-2.0", 40000, 40047, 1, "Licensed under the Apachee License, Version 2.0"), (None, "Proprietary", 0, 19, 0, "ALL RIGHTS RESERVED")]
    want += [(5, "MIT", 0, 30, 0, "released under the MIT license"), (5, "MIT", 32, 62, 0, "Released under the MIT License")] * 2
    assert got == sorted(map(str, want))
    assert ls.notices(docs(spark, [])).collect() == []
