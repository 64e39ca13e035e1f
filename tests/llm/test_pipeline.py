"""Each stage on its own input against a brute-force version."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lotline.llm.common import written
from tests.llm import (test_decontamination as decontamination_tests, test_mixing as mixing_tests,
                       test_near_duplicates as near_tests, test_quality_rules as quality_tests, test_token_files as token_tests)

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], DIR), "test-stage"))
    return docs


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.schema.names == steps[0].schema.names
    assert steps[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality(spark, steps):
    before, after = steps[0].collect(), set(steps[1].collect())
    assert after < set(before)
    assert not [r for r in after if quality_tests.brute(r.text)[-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    judged = [r for r in before if r.doc_id in labels and not quality_tests.brute(r.text)[-1]]
    assert sum((r in after) == (labels[r.doc_id] == 1) for r in judged) >= 0.98 * len(judged)


def test_near_duplicates(spark, steps):
    before, after = rows_of(steps[1]), rows_of(steps[2])
    classes = near_tests.brute(spark, before)
    assert sorted(i for i, _ in after) == sorted(min(ids) for ids in classes) and set(after) <= set(before)


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, after = rows_of(steps[2]), rows_of(steps[3])
    dirty = {r[0] for r in decontamination_tests.brute(before, items) if r[-1]}
    assert dirty and sorted(after) == sorted(r for r in before if r[0] not in dirty)


def test_mixing(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    sizes, taken, times = defaultdict(int), defaultdict(int), Counter()
    for r in before.values():
        sizes[r.source] += len(mixing_tests.WORD.findall(r.text))
    cut = Counter()
    for r in steps[4].collect():
        whole = before[r.doc_id]
        n = len(mixing_tests.WORD.findall(r.text))
        taken[whole.source] += n
        times[r.doc_id] += 1
        if r.text != whole.text:
            cut[r.source] += 1
            assert r.text == " ".join(mixing_tests.WORD.findall(whole.text)[:n]) and r.n_chars == len(r.text)
    want = mixing_tests.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert max(times.values()) <= 3 and all(n <= 1 for n in cut.values())


def test_token_files(spark, steps):
    got = sorted(tuple(r) for r in steps[5].collect())
    rows = sorted(rows_of(steps[4]), key=lambda r: r[0])
    by_text = sorted((i, n, crc) for i, _, n, crc in token_tests.brute(rows))
    assert sorted((i, n, crc) for i, _, n, crc in got) == by_text
    starts = sorted((start, n) for _, start, n, _ in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]
    assert [i for _, i in sorted((start, i) for i, start, _, _ in got)] == sorted(i for i, *_ in got)


def test_odd_rows_and_empty_tables(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    prose = ["Plain words of prose number %d go on and on. Here is more of them, and it ends well." % i for i in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", 9) for i, t in enumerate(prose)] + [(None, None, None, None, None), (9, "", "en", "s0", 0)]
    for made in (rows + rows[:1] * 2, []):
        docs = spark.createDataFrame(made, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DIR), "test-odd")
        assert (docs.count() > 0) == bool(made)
