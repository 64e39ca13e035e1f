import re
from collections import defaultdict

import numpy as np
import pytest

from lotline.llm import mixing
from lotline.llm.common import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, size string, h string"


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **{s: 3.0 * sizes[s] for s in capped}}
        capped |= over


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    placed, sources = mixing.place(docs, **options)
    placed = cut_lineage(placed)
    takes = mixing.draw_takes(placed, sources, shards=options.pop("shards", 5))
    return placed, sources, takes


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 7 if i % 3 else 0}", "x", "y")
            for i in range(400)]
    return made + [made[3]] * 3 + [(None, "a b\tc\n", None, None, None), (1007, None, "s1", None, None),
                                   (1007, None, "s1", None, None), (1008, "", "empty", None, None)]


def test_targets_and_taken_words(spark, rows):
    placed, _, takes = run(spark, rows, block_words=50)
    got = mixing.taken_words(placed, takes).collect()
    assert len(got) == len(rows)
    sizes, per_doc = defaultdict(int), []
    for doc_id, text, source, *_ in rows:
        size = len(WORD.findall(text or ""))
        sizes[source] += size
        per_doc.append((str(doc_id), size))
    want = targets(sizes)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted(per_doc)
    source_of = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.taken_words(*[f for f in run(spark, rows, block_words=50)[::2]]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_tree_gives_every_block_to_one_shard(spark):
    quotas = np.array([0, 1, 37, 512, 90])
    seen = [mixing.shard_quotas(s, 9, quotas, 3) for s in range(9)]
    for k, quota in enumerate(quotas):
        runs = sorted((int(f[k]), int(n[k])) for f, n in seen if n[k])
        assert [f for f, _ in runs] == np.cumsum([0] + [n for _, n in runs])[:-1].tolist()
        assert sum(n for _, n in runs) == quota
        assert sorted(mixing.permuted(np.arange(quota), int(quota), 4)) == list(range(quota))
    totals = [int(n.sum()) for _, n in seen]
    assert max(totals) - min(totals) <= 4


def test_draws_are_disjoint_and_mix_keeps_columns(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, shards=4, block_words=50)
    taken = mixed.select("row.*", "words", "epoch", "shard").collect()
    assert all(len(WORD.findall(r.text)) == r.words for r in taken)
    placed, _, takes = run(spark, rows, block_words=50)
    assert sum(r.words for r in taken) == takes.groupBy().sum("words").first()[0]
    assert takes.count() == placed.selectExpr("sum(size(takes)) n").first().n == len(taken)
    mixing.write_shards(mixed, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == len(taken) and set(docs.columns) < set(back.columns)


def test_empty_table(spark):
    placed, _, takes = run(spark, [])
    assert mixing.taken_words(placed, takes).collect() == []
    only_nothing = run(spark, [(1, "", "a", None, None)])
    assert mixing.taken_words(only_nothing[0], only_nothing[2]).first().taken == 0


def test_blocks_grow_with_the_total(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    docs = spark.createDataFrame([(i, "word " * 100, f"s{i % 3}") for i in range(60)], "doc_id bigint, text string, source string")
    placed, sources = mixing.place(docs, block_words=2)
    assert 45 <= sources.agg({"blocks": "sum"}).first()[0] <= 53
    taken = mixing.taken_words(placed, mixing.draw_takes(placed, sources)).agg({"taken": "sum"}).first()[0]
    assert taken == sources.agg({"quota": "sum"}).first()[0]
