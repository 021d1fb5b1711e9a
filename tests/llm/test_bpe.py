import random

import pytest

from graphloom.llm.bpe import Encoder, Merges, bpe_encode, load_ranks, replay

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))


def test_replay_is_the_library_and_decodes_back(ranks):
    lib = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    texts = ["", "a" * 5000, "ab" * 3000, "ha" * 99 + "h", "Straße ünïcödé 中文 🎉🎉", "x\n\n  y   \t z", "the " * 2000, "don't we'll 1234567 ###"]
    texts += ["".join(r.choice("abetion srn\n'é中1.") for _ in range(r.randint(1, 400))) for _ in range(400)]
    texts += ["".join(r.choice("aeab") for _ in range(r.randint(1, 60))) for _ in range(400)]
    enc = Encoder(ranks, tokenizers.PATTERN, held=50)
    for start in range(0, len(texts), 37):
        batch = texts[start : start + 37]
        for t, ids in zip(batch, enc.encode(batch)):
            assert list(memoryview(ids).cast("I")) == lib.encode_ordinary(t)
            assert enc.decode(ids) == t.encode()


def test_replay_takes_a_lower_rank_that_a_merge_opens():
    small = {bytes([c]): c for c in range(256)} | {b"abc": 300, b"bc": 310, b"ab": 320, b"abca": 299}
    lib = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks={k: i for i, (k, _) in enumerate(sorted(small.items(), key=lambda x: x[1]))}, special_tokens={})
    dense = {k: i for i, (k, _) in enumerate(sorted(small.items(), key=lambda x: x[1]))}
    words = [b"abcabcabc", b"aabbcc", b"bcbcabab", b"abcab"]
    assert replay(words, Merges(dense)) == [lib.encode_ordinary(w.decode()) for w in words]


def test_frame(spark, ranks):
    docs = spark.createDataFrame([(1, "Hello hello", 5), (2, None, None), (None, "", 1), (1, "Hello hello", 5)], "doc_id long, text string, n_tokens long")
    got = bpe_encode(docs, ranks, tokenizers.PATTERN).collect()
    assert sorted((str(x.doc_id), x.decoded, x.n_tokens == len(x.ids)) for x in got) == [("1", "Hello hello", True)] * 2 + [("2", "", True), ("None", "", True)]
    assert bpe_encode(docs.limit(0), ranks, tokenizers.PATTERN).count() == 0
