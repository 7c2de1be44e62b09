"""Fuzzy search for short licence notices.

A notice may differ from its pattern by up to ``max_errors`` inserted, deleted or substituted characters, and by no more than
one for every eight characters of the pattern ("all rights reserved": two), as a short one would else be found in
anything. By the pigeonhole principle, of a pattern split into one seed more than that at least one stands unchanged in every such
notice; one Aho-Corasick pass over the case-folded text finds all seeds of all patterns, each hit names a window
in which the notice would have to lie, and the regex library's bounded-error matching decides and reports the
spans. Overlapping windows of a pattern are joined first, so every candidate is matched whole.

Defined results: offsets are characters of the text (case folding here keeps lengths); reported spans never
overlap: of overlapping matches the one with fewest edits stays, then the longest, leftmost, first listed; null and
empty texts have none; a very long text is searched whole; equal rows give equal results; an empty table gives an empty result; other columns are
never read. A notice has to keep one seed, which holds for any with at most max_errors edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns

MAX_ERRORS = 3

NOTICES = (
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("GPL-2.0", "licensed under the gnu general public license, version 2"),
    ("GPL-3.0", "licensed under the gnu general public license, version 3"),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("AGPL-3.0", "licensed under the gnu affero general public license"),
    ("BSD", "redistribution and use in source and binary forms, with or without modification"),
    ("BSD-3-Clause", "licensed under the bsd 3-clause license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license, v. 2.0"),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY", "licensed under a creative commons attribution"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Proprietary", "all rights reserved"),
)


def fold(text: str) -> str:
    """Lower case, character by character where that keeps the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def allowed(pattern: str, max_errors: int) -> int:
    """Short notices get fewer errors: one for every eight characters at most."""
    return min(max_errors, len(pattern) // 8)


def seeds(pattern: str, errors: int) -> list[tuple[int, str]]:
    """(offset, text) of errors + 1 pieces of about equal length."""
    cuts = [len(pattern) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Scanner:
    notices: tuple[tuple[str, str], ...]
    max_errors: int

    def build(self):
        import ahocorasick
        import regex

        found = ahocorasick.Automaton()
        table: dict[str, list[tuple[int, int]]] = {}
        compiled = []
        for k, (_, pattern) in enumerate(self.notices):
            errors = allowed(pattern, self.max_errors)
            compiled.append((regex.compile(f"(?e)(?:{regex.escape(pattern, literal_spaces=True)}){{e<={errors}}}"), errors, len(pattern)))
            for offset, seed in seeds(pattern, errors):
                table.setdefault(seed, []).append((k, offset))
        for seed, uses in table.items():
            found.add_word(seed, (len(seed), uses))
        found.make_automaton()
        return found, compiled

    def windows(self, automaton, compiled, low: str) -> dict[int, list[list[int]]]:
        """Of each pattern, the stretches of the text in which a match would have to lie, joined where they touch."""
        out: dict[int, list[list[int]]] = {}
        for end, (size, uses) in automaton.iter(low):
            for k, offset in uses:
                _, errors, length = compiled[k]
                start = end + 1 - size - offset
                lo, hi = max(0, start - errors), min(len(low), start + length + errors)
                own = out.setdefault(k, [])
                own.append([lo, hi])
        for k, own in out.items():
            own.sort()
            joined = [own[0]]
            for lo, hi in own[1:]:
                if lo <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            out[k] = joined
        return out

    def scan(self, automaton, compiled, text: str) -> list[tuple[int, int, int, int]]:
        """(pattern, start, end, edits) of all notices in a text."""
        low = fold(text)
        out = []
        for k, stretches in self.windows(automaton, compiled, low).items():
            rule = compiled[k][0]
            for lo, hi in stretches:
                out += [(k, m.start(), m.end(), sum(m.fuzzy_counts)) for m in rule.finditer(low, lo, hi)]
        return best_apart(out)


def best_apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping (pattern, start, end, edits), those with fewest edits; of these the longest, leftmost, first pattern."""
    kept: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # sorted, apart
    for m in sorted(found, key=lambda m: (m[3], m[1] - m[2], m[1], m[0])):
        at = bisect_left(taken, (m[1], m[2]))
        if (at == 0 or taken[at - 1][1] <= m[1]) and (at == len(taken) or taken[at][0] >= m[2]):
            taken.insert(at, (m[1], m[2]))
            kept.append(m)
    return sorted(kept, key=lambda m: m[1:])


@cache
def _built(scanner: Scanner):
    return scanner.build()


FOUND = "doc_id long, license string, start int, end int, edits int, matched string"


def notices(docs: DataFrame, patterns: tuple[tuple[str, str], ...] = NOTICES, max_errors: int = MAX_ERRORS) -> DataFrame:
    """(doc_id, license, start, end, edits, matched) of every notice in every row; start and end are characters."""
    scanner = Scanner(tuple((n, fold(p)) for n, p in patterns), max_errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, compiled = _built(scanner)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    rows += [(doc_id, scanner.notices[k][0], a, b, e, text[a:b]) for k, a, b, e in scanner.scan(automaton, compiled, text)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return doc_columns(docs).filter("text <> ''").mapInArrow(run, FOUND)
