"""The pipeline on a small fixture: what each stage must drop and keep, and its stages one by one."""

from __future__ import annotations

import os
import random

import corpus_pipeline
from tests.llm.helpers import DOCS, docs, with_clashes

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north ocean plain quarry ridge stone trail".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "s", "er", "ing")) for _ in range(n))


def fixture():
    shared = prose(900, 80)
    rows = [(k, prose(k, 200)) for k in range(10, 20)]
    rows += [(30, rows[0][1]), (31, rows[0][1])]  # copies of 10
    rows += [(40, rows[1][1].replace("amber", "amb", 1) + " tail")]  # a near copy of 11
    rows += [(50, prose(50, 150) + " " + shared + " " + prose(51, 150)), (51, prose(52, 150) + " " + shared + " " + prose(53, 150))]
    rows += [(60, None), (61, "")]
    return rows, shared


def test_run_equals_brute_force(spark, tmp_path):
    rows, shared = fixture()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = dict(rows)
    want = {k: len(text[k]) for k in [*range(10, 20), 50]}
    size: dict[int, int] = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert {k: v for k, v in size.items() if k != 51} == want
    # 51 loses the passage that 50 has first, and the blanks around it may stay or go
    assert 0 <= len(text[51]) - len(shared) - size[51] + 2 <= 4
    load: dict[int, int] = {}
    for r in got:
        load[r.bin] = load.get(r.bin, 0) + r.length
    assert max(load.values()) <= 32768


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.isEmpty(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == empty.columns and [f.dataType for f in out.schema] == [f.dataType for f in DOCS], name


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    long = prose(1, 9000)
    rows = [(1, long), (1, long), (2, long), (None, prose(2, 200)), (None, prose(2, 200)), (3, prose(3, 200)), (4, prose(3, 200).upper()), (5, None), (5, ""), (None, None), (6, "x")]
    df = with_clashes(docs(spark, rows))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, df, "").write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == df.columns and out.filter("digest <> 'x-digest' or kept <> 'x-kept'").isEmpty()
        df = out
    kept = sorted(((r.doc_id is None, r.doc_id or 0), len(r.text), r.n_chars) for r in df.collect())
    assert [k for k, _, _ in kept if k != (False, 6)] == [(False, 1), (False, 3), (True, 0)] and all(n == c for _, n, c in kept)
    whole = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert sum(r.length for r in whole if r.doc_id == 1) == len(long) and sum(r.doc_id == 1 for r in whole) > 1


def test_run_leaves_only_its_result(spark, tmp_path):
    rows, _ = fixture()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    folder = corpus_pipeline.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    (made,) = set(os.listdir(folder)) - before
    assert made.startswith("pipeline-") and len(os.listdir(f"{folder}/{made}")) == 1 and out.count() > 0
