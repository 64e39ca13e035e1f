"""Ids by words against the libraries, on texts made to break the cuts, and when the table is emptied again and again."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lotline.llm import token_alignment, token_files, word_ids
from lotline.llm.queries import tokenizer_path


def odd_texts(n):
    rng = random.Random(3)
    letters = list("ab'.,;:!?s tdé÷×ɐ世1 \n　\xa0%$'ſ▁\t")
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["", " ", "a", "word, word.\nWord; word!"]


@pytest.mark.parametrize("known", [1 << 20, 300])
def test_ids_are_the_library_s(known, monkeypatch):
    monkeypatch.setattr(word_ids, "KNOWN", known)
    coder, texts = token_files.Coder(tokenizer_path()), odd_texts(4000)
    got = []
    for at in range(0, len(texts), 250):
        got += coder.texts(texts[at:at + 250])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_both_sides_of_the_alignment():
    a, b = token_alignment.sides(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts(3000)
    cut = word_ids.Cut(pa.array(texts), spaced=True)
    for side, plain in ((a, lambda t: a.tokenizer.encode(" " + t, add_special_tokens=False).ids), (b, b.model.encode)):
        ids, counts = side.ids(cut)
        ends = np.cumsum(counts)
        for k, text in enumerate(texts):
            want = plain(text) if text else []
            if b"".join(side.bytes[i] for i in want) != b" " + text.encode():
                want = []
            assert ids[ends[k] - counts[k]:ends[k]].tolist() == want, repr(text)


def test_words_are_found_again():
    coder = token_files.Coder(tokenizer_path())
    texts = pa.array(["one two three", "two, three\nfour", "one"])
    first, again = coder.ids(texts), coder.ids(texts)
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()
    assert coder.plain.n_words <= 8


def test_the_table_grows_with_its_words():
    """A worker with few words holds a small table, and one with many finds them all again."""
    coder = token_files.Coder(tokenizer_path())
    plain, texts = coder.plain, pa.array([" ".join(f"w{k}x{i}" for i in range(500)) for k in range(400)])
    held = lambda: sum(x.nbytes for x in (plain.table_keys, plain.table_entries, plain.firsts, plain.sizes, plain.ids))
    coder.ids(texts.slice(0, 1))
    assert held() < 1 << 23
    for at in range(0, 400, 50):
        coder.ids(texts.slice(at, 50))
    assert plain.n_words == 200_000 and 3 * plain.n_words <= len(plain.table_keys) < 1 << 21
    ids, counts = coder.ids(texts)
    assert plain.n_words == 200_000
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
