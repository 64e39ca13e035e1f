import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lotline.llm import common, repeated_bytes, suffix_runs as runs
from lotline.llm.queries import op5_repeated_bytes


def brute(rows):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    count = Counter(t[s:s + 200] for _, t in texts for s in range(len(t) - 199))
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - 199):
            if count[t[s:s + 200]] > 1:
                gone[s:s + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def made():
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(60), prose(200)
    rows = [(i, prose(30) + " " + passage + " " + prose(30)) for i in range(12)]
    rows += [(20 + i, long[i * 7:i * 7 + 400]) for i in range(10)]
    rows += [(40, long), (41, long), (41, long), (42, prose(5) + long[:199]), (43, prose(5) + long[:200]), (44, None), (45, ""),
             (46, "a" * 199), (47, "a" * 200), (48, "b" * 201), (49, "xy" * 5000), (50, "é" * 150 + prose(40)),
             (51, prose(3) + "é" * 150), (52, prose(80)), (None, passage), (53, passage[3:] + passage[3:])]
    twice = prose(70)
    return rows + [(60, twice + " - " + twice), (61, "q" * 300 + prose(20) + "q" * 250)]


def test_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "z") for r in made()], "doc_id bigint, text string, start int, kept string")
    want = brute(made())
    assert result(repeated_bytes.without_repeats(docs).collect()) == want
    monkeypatch.setattr(repeated_bytes, "HOT", 8)  # the other way for frequent grams
    assert result(repeated_bytes.without_repeats(docs).collect()) == want


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(op5_repeated_bytes(spark, sf_dir).collect()) == brute(docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeated_bytes.without_repeats(docs).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=12), max_size=12), min_size=1, max_size=7))
def test_merge_of_front_coded_runs(texts):
    lists = [sorted(t.encode() for t in run) for run in texts]
    got = list(runs.merged([runs.expanded(*runs.front_coded(run)) for run in lists]))
    want = sorted(s for run in lists for s in run)
    assert [s for _, s, _ in got] == want
    assert [l for _, _, l in got] == [runs.common_prefix(a, b) for a, b in zip([b""] + want, want)]
    for r, run in enumerate(lists):
        assert [s for k, s, _ in got if k == r] == run


def test_merge_reads_known_prefixes_once(monkeypatch):
    """Bytes are compared only behind what is known: in all, about the text and not the text times the tree."""
    compared = []
    plain = runs.common_prefix
    monkeypatch.setattr(runs, "common_prefix",
                        lambda a, b, known=0: (n := plain(a, b, known), compared.append(n - known))[0])
    lists = [sorted((b"p" * 150 + b"%04d" % (8 * i + r)) for i in range(200)) for r in range(8)]
    coded = [runs.front_coded(run) for run in lists]
    compared.clear()
    assert len(list(runs.merged([runs.expanded(*c) for c in coded]))) == 1600
    assert sum(compared) < 20 * 1600


def test_windows_of_equal_texts_have_equal_anchors():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    data = np.concatenate([text, rng.integers(97, 123, 500).astype(np.uint8), text])
    ends = np.array([3000, 3500, 6500])
    place, lo, hi, gram = runs.anchors(data, ends)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert len(covered) == 2801 + 301 + 2801 == len(set(covered.tolist()))
    first, last = lo < 3000, lo >= 3500
    assert (place[first] == place[last] - 3500).all() and (gram[first] == gram[last]).all()


def test_tables_that_meet_the_texts_are_narrow(spark, monkeypatch):
    """Anchors and stretches may be broadcast, so each takes eight bytes."""
    widths = []
    plain = common.join_small

    def measured(rows, small, *args, **options):
        if arrays := [f for f in small.schema if f.dataType.typeName() == "array"]:
            taken = sum((common._bytes(small[f.name], f.dataType) - 32 for f in arrays), F.lit(0))
            widths.append(small.select(F.sum(taken) / F.sum(F.size(arrays[0].name))).first()[0])
        return plain(rows, small, *args, **options)

    monkeypatch.setattr(repeated_bytes, "join_small", measured)
    docs = spark.createDataFrame(made(), "doc_id bigint, text string")
    assert result(repeated_bytes.without_repeats(docs).collect()) == brute(made())
    assert widths == [8, 8]


def test_tables_beyond_the_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame(made(), "doc_id bigint, text string")
    assert result(repeated_bytes.without_repeats(docs).collect()) == brute(made())


def test_anchors_of_long_texts_as_numbers():
    place = np.array([0, 136, 500, (1 << 31) - 264])
    lo, hi = place - [0, 136, 90, 136], place - [0, 0, 17, 136]
    assert [x.tolist() for x in repeated_bytes._placed(repeated_bytes._at(place, lo, hi))] == [
        x.tolist() for x in (place, lo, hi)]


def test_grams_of_places():
    data = np.random.default_rng(4).integers(0, 256, 3000).astype(np.uint8)
    places = np.array([0, 1, 70, 2900, 2936])
    assert (runs.gram_hashes_at(data, places) == runs.gram_hashes(data)[places]).all()


def test_merge_holds_one_part_of_a_batch():
    """A batch holds the runs of many parts; only a few of them at a time become Python objects."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, 400).astype(np.uint8)) for _ in range(60)]
    pool = pa.table({"text_key": pa.array([bytes([i]) * repeated_bytes.KEY_BYTES for i in range(90)], pa.binary()),
                     "text": pa.array(texts + texts[:30], pa.binary())})
    held = {k: [] for k in pool["text_key"].to_pylist()}
    for batch in repeated_bytes._anchors(iter(pool.to_batches())):
        for row in batch.to_pylist():
            held[row.pop("text_key")].append(row.get("at", row))
    pool = pool.append_column("anchors", pa.array(list(held.values())))
    coded = pa.Table.from_batches(list(repeated_bytes._run_maker(4)(iter(pool.to_batches()))) * 100)
    coded = coded.set_column(0, "part", pa.array(range(coded.num_rows), pa.int32()))  # each run a part of its own
    (batch,) = coded.combine_chunks().to_batches()

    def peak(one):
        tracemalloc.start()
        sum(x.num_rows for x in repeated_bytes._merge(iter([one])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert batch.num_rows == 400 and peak(batch) < 1.5 * peak(batch.slice(0, 64))


def test_workers_give_memory_back_after_a_task(monkeypatch):
    done = []

    class Pool:
        def release_unused(self):
            done.append("released")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    monkeypatch.setattr(pa, "system_memory_pool", Pool)
    for x in repeated_bytes._tidy(iter)(["a", "b"]):
        done.append(x)
    assert done == ["a", "b", "released", "released"]


def test_texts_left_come_back_in_small_batches():
    texts = pa.array([b"x" * (1 << 17)] * 10 + [b"", b"y" * (1 << 20), b"z"], pa.binary())
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(13), pa.int64()), texts, pa.array([False] * 13), pa.array([None] * 13, pa.list_(pa.int64()))],
        names=["doc_id", "text", "copied", "stretches"])
    out = list(repeated_bytes._cut(iter([batch])))
    assert pa.Table.from_batches(out)["kept"].to_pylist() == texts.to_pylist()
    assert all(b.num_rows == 1 or sum(len(k.as_buffer()) for k in b["kept"]) <= runs.BATCH_BYTES for b in out)
