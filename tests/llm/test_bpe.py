import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from usagelens.llm import bpe

PATTERN = public_tokenizers.PATTERN
TEXTS = [None, "", " ", "Hello world, it's 2024!", "a" * 3000, "!?" * 500 + "é" * 300 + " \n\n  x　 y \u0085 z",
         "日本語テキスト " * 50, "we'll I'm they've \t\ttabs", "\x00\x1c\x1d  end ", "emoji 😀👩‍👩‍👧 fin", "Hello world, it's 2024!"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def peer(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(word=st.binary(min_size=1, max_size=300))
def test_words_of_any_bytes(ranks, peer, word):
    expected = peer._core_bpe.encode_single_piece(word)
    assert bpe.encode_word(word, ranks) == expected
    if len(word) > 1 and word not in ranks:
        assert bpe._encode_long(word, ranks) == expected


def test_short_and_long_forms_agree(ranks):
    chance = random.Random(1)
    for _ in range(200):
        word = bytes(chance.choice(b"aber tinos") for _ in range(chance.randint(2, 95)))
        if word not in ranks:
            assert bpe._encode_long(word, ranks) == bpe.encode_word(word, ranks)


def rows(spark):
    texts = [(k % 7 if k else None, text, "x") for k, text in enumerate(TEXTS * 3)]
    return spark.createDataFrame(texts, "doc_id long, text string, ids string").repartition(3), texts


def test_ids_equal_the_public_encoder(spark, ranks, peer):
    docs, texts = rows(spark)
    for block in (40, 1 << 20):
        got = bpe.bpe_encode(docs, ranks, PATTERN, block_chars=block).collect()
        assert Counter((row.doc_id, tuple(row.ids)) for row in got) == Counter(
            (doc, tuple(peer.encode_ordinary(text or ""))) for doc, text, _ in texts)


def test_digests(spark, ranks, peer):
    docs, texts = rows(spark)
    got = bpe.bpe_encode(docs, ranks, PATTERN, answer="digests").collect()
    expected = []
    for doc, text, _ in texts:
        ids = peer.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(expected)


def test_decoding_gives_the_bytes_back(spark, ranks):
    docs, texts = rows(spark)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, PATTERN, answer="all"), ranks).collect()
    assert Counter(bytes(row.decoded) for row in back) == Counter((text or "").encode() for _, text, _ in texts)
    lone = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [row.decoded for row in bpe.bpe_decode(lone, ranks).collect()] == [None, b""]


def test_empty_table(spark, ranks):
    assert bpe.bpe_encode(spark.createDataFrame([], "doc_id long, text string"), ranks, PATTERN).collect() == []
