"""What the encoder remembers, and the cutting of many streams at once."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from sparkfolio.llm import token_store as t
from sparkfolio.llm.text import pieces
from tests.llm.test_token_speed import plain_cuts


def test_words_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(t, "CACHE", 60)
    encode, learned = t.Encoder(os.fspath(public_tokenizers.path("word_bpe_49k.json"))), []
    learn = encode.learn
    encode.learn = lambda key, check, raws: (learned.extend(raws), learn(key, check, raws))
    assert encode.by_words
    encode.forget()
    for k in range(40):
        text = f"common words stay known w{k} été-{k} x<|endoftext|>y{k}, <|startoftext|>{k} " + " ".join(f"rare{'abcdefghij'[j]}{'abcdefghij'[k % 10] * (k + 1)}" for j in range(10))
        p = next(pieces(pa.array([text, None, "known, words."])))
        for a, b in zip(encode.words(p), encode.whole(p), strict=True):
            assert np.array_equal(a, b)
        assert len(encode.key) <= 60
    assert [learned.count(w) for w in (b"common", b"words", b"stay", b"known")] == [1, 1, 1, 1]


def test_words_all_met_again_are_forgotten_when_they_are_most(monkeypatch):
    monkeypatch.setattr(t, "CACHE", 8)
    encode = t.Encoder(os.fspath(public_tokenizers.path("word_bpe_49k.json")))
    for text in ("a b c d e f", "a b c d e f", "g h i", "a b", "j k l m n o p q r s t"):
        p = next(pieces(pa.array([text])))
        assert np.array_equal(encode.words(p)[0], encode.whole(p)[0])


def test_cuts_of_many_streams_are_those_of_each():
    rng = np.random.default_rng(11)
    for width in ("<u2", "<u4"):
        streams = [rng.integers(0, high, n).astype(width) for n, high in ((1, 9), (5000, 60000), (0, 9), (20, 9), (128, 60000), (129, 60000), (9000, 1), (31, 60000), (7000, 900))]
        bounds = np.append(0, np.cumsum([len(x) for x in streams]))
        assert list(t.cuts_of(np.concatenate(streams), bounds)) == [plain_cuts(x) for x in streams]
