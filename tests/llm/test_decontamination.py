import re

from lotline.llm import decontamination as decontam
from lotline.llm.queries import ORACLE_SQL, op2_decontamination
from tools.check_oracle import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        words = words_of(text)
        for s in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[s:s + 10]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for window, ids in windows.items():
            n = len(window)
            for s in range(len(words) - n + 1):
                if tuple(words[s:s + n]) == window:
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((doc_id, len(words), len(hit), sorted(str(i) for i in found if i is not None), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id bigint, text string, n_hit int, key string")
    rows = decontam.decontaminated(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows.collect()), key=str)


ITEM = " ".join(f"w{i}" for i in range(14))


def test_brute_force(spark):
    items = [(1, ITEM), (2, "Short ITEM, here"), (3, None), (4, "..."), (5, ITEM), (5, ITEM), (None, "né only this"),
             (6, "a a a a a a a a a a a"), (7, "Étude"), (8, "x y z w")]
    docs = [(1, ITEM), (2, "W0-w1_w2 w3\nw4 w5 w6 w7 w8 w9!"), (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (4, None), (5, ""),
            (6, "the short item here short item here"), (7, "a " * 30), (8, "Né only THIS"), (9, "étude Étude"),
            (10, "x y z"), (11, ITEM + " " + ITEM), (11, ITEM + " " + ITEM), (None, "x y z w"),
            (12, "q " * 40_000 + ITEM + " q" * 40_000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    ok, count, _, detail = compare(spark, connect(sf_dir), "op2", sf_dir, op2_decontamination,
                                   ORACLE_SQL["op2_decontamination"])
    assert ok and count == 1000, detail


def test_empty_tables(spark):
    assert run(spark, [(1, ITEM)], []) == [(1, 14, 0, [], False)]
    assert run(spark, [], [(1, ITEM)]) == []


def test_keep_clean(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "clean", "b"), (3, None, None)], "doc_id int, text string, row string")
    kept = decontam.keep_clean(docs, spark.createDataFrame([(1, ITEM)], "item_id int, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
