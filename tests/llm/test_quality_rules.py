import re

from lotline.llm import quality_rules as quality
from lotline.llm.queries import op1_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


def test_base_over_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_quality_rules(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_kept_follows_the_labels(spark):
    """Labels are not read by the operator; they measure it."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    rows = op1_quality_rules(spark, sf_dir).join(labels, "doc_id").where("not base_failed").collect()
    right = sum((r.label == 1) == r.kept for r in rows)
    assert len(rows) > 300 and right >= 0.98 * len(rows)


def test_odd_rows(spark):
    texts = [None, "", " \n\n ", "a b c d e " * 3, "x y\nx y\n\n\n x y\nx y", "w " * 9, "é \U0001F600 \x1c",
             " ".join(f"w{i}." if i % 12 == 11 else f"w{i}" for i in range(20_000)), "one two three four five six " + "seven " * 5_000,
             "same line of words here\n" * 50, "a a a a a b a a a a a", " ".join(f"w{i}" for i in range(20_000))]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(texts)] * 2 + [(None, "x", None, None)],
                                 "doc_id bigint, text string, n_words int, row string")
    rows = quality.quality_rows(docs).collect()
    assert len(rows) == 2 * len(texts) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute(r.row.text)
    kept = quality.keep_good(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 7 in ids
    assert 11 not in ids  # 20,000 words without the end of a sentence


def test_filters_do_not_work_out_the_measures_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    rows = quality.judged(quality.measured(docs), quality.Model((0.9,) * len(quality.RULES)))
    plan = rows.where("kept and not base_failed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") == rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_count")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.quality_rows(docs).collect() == []


def test_em_learns_from_agreement(spark):
    """Rule 0 agrees with rule 1 and contradicts rule 2 where they meet."""
    rules = [quality.Rule(str(i), v, lambda m: True) for i, v in enumerate((-1, -1, 1))]
    votes = [[-1, -1, 0]] * 50 + [[0, 0, 1]] * 300 + [[-1, -1, 1]] * 20 + [[0, 0, 0]] * 10
    model = quality.fit(spark.createDataFrame([(v,) for v in votes], "votes array<int>"), rules)
    assert model.accuracies[0] > 0.9 and all(0.55 <= a <= 0.99 for a in model.accuracies)
    again = quality.fit(spark.createDataFrame([(v,) for v in votes[::-1]], "votes array<int>"), rules)
    assert again == model
