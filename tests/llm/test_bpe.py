import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from veilspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


def other(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_as_the_library(ranks):
    with open(PATH, "rb") as file:
        encode, decode = bpe.codec(file.read(), public_tokenizers.PATTERN)
    theirs, draw = other(ranks), random.Random(5)
    words = [w.decode("utf-8", "ignore") for w in ranks]
    texts = ["", " ", "a" * 3000, "ab" * 900 + "c", "\n\n  x\t", "<|endoftext|>", "naïve 漢字 🙂🙂"]
    texts += ["".join(draw.choice(words) for _ in range(draw.randint(1, 12))) for _ in range(300)]
    texts += ["".join(chr(draw.choice([draw.randint(32, 126), draw.randint(160, 0x2000), 97, 98])) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    for text in texts:
        ids = encode(text)
        assert list(array("I", ids)) == theirs.encode_ordinary(text)
        assert decode(ids) == text.encode()


def test_tiny_vocabulary_matches_repeated_merging():
    # b"abc" ranks before its part b"bc", as in vocabularies that are not ordered by merge
    ranks = {bytes((i,)): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"aa": 258, b"aab": 259}
    codec = bpe.Bpe(ranks)
    for text in (b"abcabc", b"aabc", b"aaaab", b"bcbca", b"aaabcaab"):
        parts = [bytes((x,)) for x in text]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [codec.words[t] for t in codec.encode_piece(text)] == parts


def test_frame_with_nulls_repeats_and_extra_columns(spark, ranks):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, None), (None, "", "y"), (3, "é" * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)
    theirs, want = other(ranks), []
    for doc_id, text, _ in rows:
        ids = theirs.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
