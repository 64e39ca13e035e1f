import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lotline.llm import simple8b, token_files
from lotline.llm.queries import op9_token_files, tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 40), st.integers(0, 60_000),
                          st.integers(0, 2**32 - 1)), max_size=700))
def test_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    words, escapes, word_at, escape_at = simple8b.encode(ids)
    assert simple8b.decode(words, escapes, word_at, escape_at, len(ids)).tolist() == ids.tolist()


def test_blocks_decode_alone():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(50_000) < 0.7, rng.integers(0, 300, 50_000), rng.integers(0, 50_257, 50_000))
    ids[20_000:21_000] = 0
    coded = simple8b.encode(ids)
    b = simple8b.BLOCK
    assert simple8b.decode(*coded, len(ids), 1, 2).tolist() == ids[b:2 * b].tolist()
    assert simple8b.decode(*coded, len(ids)).tolist() == ids.tolist()
    assert len(coded[0]) * 8 + len(coded[1]) * 4 < 3 * len(ids)


def brute(rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf_dir):
    got = [tuple(r) for r in op9_token_files(spark, sf_dir).orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, tmp_path):
    texts = [None, "", "\nx", "x\n", "x\n\ny", "x\n\n\ny", "a\tb\nc", "foo\t\n\tbar", "a\r\nb c\r\n", "1 2\n3", "a  b", "a   b", "x \n y", "x\n  y", "x\n y", " lead", "end ", "end\n ", " ", "\n \t q r", "  two  spaces\n\n\tand 'll it's <|endoftext|> 12345 ñandú   x \U0001F600",
             "a" * 3000, " \n ", "word " * 200_000, "\x00\x1c\x1f y"]
    rows = [(i, t, "start") for i, t in enumerate(texts)] + [(1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows + [(None, "no id", "z")], "doc_id bigint, text string, start string")
    token_files.write_ids(docs, str(tmp_path / "a"), tokenizer_path())
    ids = token_files.read_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in ids] == [None, 0, 1, 1, 1, *range(2, len(texts))]
    assert [r.start for r in ids] == np.cumsum([0] + [len(r.ids) for r in ids])[:-1].tolist()
    tokenizer = token_files.Coder(tokenizer_path()).tokenizer
    for r in ids[5:]:
        assert r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write_ids(docs, str(tmp_path / "a"), tokenizer_path())
    assert token_files.read_digests(spark, str(tmp_path / "a")).collect() == []


@pytest.mark.parametrize("path", ["documents"])
def test_pieces_have_the_library_ids(spark, path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
             .select("text").limit(150).collect()]
    coded = token_files.Coder(tokenizer_path())
    for text in texts:
        whole = coded.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coded.texts([text])[0], "<u4").tolist() == whole


def test_frames_become_objects_one_at_a_time():
    """A batch holds all frames of a task; reading it takes memory for one of them."""
    ids = np.random.default_rng(5).integers(0, 50_000, 30_000).astype(np.uint32)
    words, escapes, word_at, escape_at = simple8b.encode(ids)
    frame = {"shard": 0, "first": 0, "doc_ids": list(range(3000)), "lengths": [10] * 3000, "words": words.tobytes(),
             "escapes": escapes.tobytes(), "word_at": word_at.tolist(), "escape_at": escape_at.tolist(), "before": 0}
    batch = pa.RecordBatch.from_pylist([frame] * 60)

    def peak(one):
        tracemalloc.start()
        assert sum(x.num_rows for x in token_files._read_digests(iter([one]))) == 3000 * one.num_rows
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(batch) < 2 * peak(batch.slice(0, 1))


def test_workers_give_memory_back(spark, tmp_path, monkeypatch):
    steps = []
    plain = token_files.tidy
    monkeypatch.setattr(token_files, "tidy", lambda step: (steps.append(step), plain(step))[1])
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    token_files.write_ids(docs, str(tmp_path / "a"), tokenizer_path())
    assert [r.n_tokens for r in token_files.read_digests(spark, str(tmp_path / "a")).orderBy("doc_id").collect()] == [3, 1]
    assert len(steps) == 2
