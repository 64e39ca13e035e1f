import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lotline.llm import near_duplicates as near
from lotline.llm.queries import op3_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def classes_by_brute_force(rows, frequency, n, bucket):
    """Classes of (doc_id, text) by all pairs, with the operator's weights."""
    idf = {w: np.log((n + 1) / (frequency[bucket[w]] + 1)) + 1 for w in bucket}
    weights = {}
    for _, text in rows:
        if text not in weights:
            weights[text] = {s: c * np.mean([idf[w] for w in s]) for s, c in shingles(text).items()}
    root = {t: t for t in weights}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    by_shingle = defaultdict(set)
    for text, held in weights.items():
        for s in held:
            by_shingle[s].add(text)
    pairs = {p for texts in by_shingle.values() for p in combinations(sorted(texts, key=str), 2)}
    for a, b in pairs:
        x, y = weights[a], weights[b]
        low = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if low / (sum(x.values()) + sum(y.values()) - low) >= 0.8:
            root[find(a)] = find(b)
    out = defaultdict(list)
    for doc_id, text in rows:
        out[find(text)].append(doc_id)
    return sorted(sorted(ids) for ids in out.values())


def brute(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = docs.select(near.white_words(near.text_of("text")).alias("words"))
    frequency, n = near.document_frequencies(words.select(near.F.transform("words", lambda w: near.F.xxhash64(w)).alias("words")))
    bucket = {r[0]: r[1] & ((1 << near.IDF_BITS) - 1) for r in words.select(near.F.explode("words").alias("w"))
              .distinct().select("w", near.F.xxhash64("w")).collect()}
    return classes_by_brute_force(rows, frequency, n, bucket)


def classes_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.class_id].append(r.doc_id)
    assert all(min(ids) == class_id for class_id, ids in out.items())
    return sorted(sorted(ids) for ids in out.values())


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3_near_duplicates(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert classes_of(got) == brute(spark, docs)
    assert sum(r.is_kept for r in got) == len({r.class_id for r in got})


def test_a_large_group_and_a_chain(spark):
    rng = np.random.default_rng(2)
    base = [f"w{rng.integers(1000)}" for _ in range(200)]
    rows = []
    for i in range(150):  # copies of a base with one or two words changed
        words = list(base)
        for at in rng.integers(0, 200, 1 + i % 2):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{k}" for k in range(300)]
    rows += [(1000 + i, " ".join(chain[10 * i:10 * i + 200])) for i in range(10)]  # 1 links with 2, 2 with 3 ...
    rows += [(2000 + i, " ".join(base[:70] + [f"y{i}_{k}" for k in range(130)])) for i in range(60)]  # a shared passage
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert classes_of(near.near_duplicates(docs).collect()) == brute(spark, rows)


def crowd(size, template=194, words=200):
    """Texts of a shared template and an end of their own: alike at about 0.7, linked to none."""
    base = [f"t{k}" for k in range(template)]
    return [(i, " ".join(base + [f"e{i}_{k}" for k in range(words - template)])) for i in range(size)]


def test_close_pairs_in_a_crowd(spark):
    rows = crowd(400)
    for i in (17, 203, 350):  # near copies of three texts of the crowd
        words = rows[i][1].split()
        words[199] = f"z{i}"
        rows.append((1000 + i, " ".join(words)))
    own = rows[60][1].split()
    for step in range(1, 6):  # versions alike only to the one before
        own[40 * step - 20] = f"v{step}"
        rows.append((2000 + step, " ".join(own)))
    want = brute(spark, rows)
    assert sum(len(ids) > 1 for ids in want) >= 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert classes_of(near.near_duplicates(docs).collect()) == want


def test_texts_alike_only_to_one_member_of_a_large_class(spark):
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        words[3 * i] = f"x{i}"
        rows.append((i, " ".join(words)))
    for j in range(5):
        words = list(base)
        words[20:26] = [f"m{j}_{k}" for k in range(6)]
        rows.append((1000 + j, " ".join(words)))
        words[120:126] = [f"p{j}_{k}" for k in range(6)]
        rows.append((2000 + j, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(spark, rows)
    assert len(want) == 1
    assert classes_of(near.near_duplicates(docs).collect()) == want


def test_odd_rows(spark):
    texts = [None, "", " \n", "one", "one", "a b c", "a  b\nc", "a b d", "long " * 20_000, "long " * 20_001, None]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "one", None, None), (3, "one", "x", 3), (3, "one", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, class string, n int")
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.class_id].add(r.doc_id)
    assert by == {0: {0, 1, 10}, 2: {2}, 3: {3, 4, None}, 5: {5, 6}, 7: {7}, 8: {8, 9}}
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5, 7, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near.near_duplicates(docs).collect() == [] and near.keep_one(docs).collect() == []


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_samples_agree_as_often_as_texts_are_similar(similarity):
    rng = np.random.default_rng(4)
    n = int(400 * 2 * similarity / (1 + similarity))
    shared, a, b = (rng.integers(0, 1 << 62, k, dtype=np.uint64) for k in (n, 400 - n, 400 - n))
    weight = rng.uniform(1, 9, 400).astype(np.float32)
    text = np.repeat([0, 1], 400)
    shingle = np.concatenate([np.concatenate([shared, a]), np.concatenate([shared, b])])
    both = np.concatenate([weight, np.concatenate([weight[:n], rng.uniform(1, 9, 400 - n).astype(np.float32)])])
    low = weight[:n].sum()
    true = low / (both.sum() - low)
    samples = near.Sampler(2000)(text, shingle, both)
    assert abs((samples[0] == samples[1]).mean() - true) < 0.04
