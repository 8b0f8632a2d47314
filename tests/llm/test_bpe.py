"""BPE against the tokenizers library, and round trips."""

import hashlib
import random

import numpy as np
import tokenizers

from orrery.llm import bpe

TOKENIZER = tokenizers.Tokenizer.from_file(bpe.default_path())
PIECES = ["<|endoftext|>", "a", "  ", "\n", "\x1c", "\x85", " ", " ", "é", "１", "²", "'s", "'S", " don't", "日本", "​", "😀", "́", "xy" * 200, "\t", "Ⅷ", "\x00", "'ll", "''re"]


def random_texts(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(12))) for _ in range(n)]


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encode_equals_library():
    codec, texts = bpe.codec(bpe.default_path()), random_texts(1500)
    for text, found in zip(texts, codec.encode_each(texts)):
        assert np.frombuffer(found, "<u4").tolist() == ids(text)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids(text)
        assert codec.decode(found) == TOKENIZER.decode(ids(text), skip_special_tokens=False)


def test_long_words_use_the_heap():
    word = "".join(random.Random(2).choice("abcdeXYZ") for _ in range(4000))
    codec = bpe.codec(bpe.default_path())
    assert np.frombuffer(codec.encode(word), "<u4").tolist() == ids(word)


def test_walk_equals_whole(monkeypatch):
    text = " ".join(random_texts(300))
    codec = bpe.codec(bpe.default_path())
    whole = codec.encode(text)
    monkeypatch.setattr(bpe, "WALK_ABOVE", 50)
    assert codec.encode(text) == whole


def test_frames(spark, corpus):
    df = spark.createDataFrame([(i, t, 1) for i, t in corpus], "doc_id long, text string, n_tokens int")
    coded = bpe.decode(bpe.encode(df.select("doc_id", "text")))
    for r in coded.collect():
        assert r["decoded"] == (r["text"] or "")
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids(r["text"] or "")
        assert r["n_tokens"] == len(r["token_ids"]) // 4
    digest = bpe.digests(df)
    for r in digest.collect():
        own = ids(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0
