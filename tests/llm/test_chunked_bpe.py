"""Chunked byte-level BPE against the library, for chunks of several sizes."""

import base64
import collections
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskspark.llm import chunked_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(VOCABULARY, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def random_text(rng, size):
    parts = ["'s", "'", "'ll", "re", " ", "  ", "\n", "\t", "a", "word", "naïve", "漢字", "😀", "12", "²", "!?", "_", "\x1c", " "]
    return "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(size))


# Nulls, blanks, special strings, runs longer than any overlap, repeated rows and ids.
rng = random.Random(5)
TEXTS = [
    (1, "The thing's done; we'll see."), (2, None), (3, ""), (4, " " * 90 + "x" + "\n" * 70 + "y  z"),
    (5, "a<|endoftext|>b"), (6, "naïve café 漢字 😀 ²³ ٣٤ \x1c\x85 end"), (7, "ab" * 300 + " " + "=-" * 70 + "'s"),
    (8, "the same row, one of three" * 9), (8, "the same row, one of three" * 9), (9, "the same row, one of three" * 9),
    (None, "no id at all, and longer than the chunks of the test"), (10, "a" * 5000), (11, "it" + "'" * 400 + "re"),
    *((100 + i, random_text(rng, 60)) for i in range(40)),
]


@pytest.mark.parametrize("chunk, overlap", [(8, 4), (40, 12), (1 << 15, 1 << 10)])
def test_equals_the_library(spark, chunk, overlap):
    # extra columns of the names the operator uses itself
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in TEXTS], "doc_id long, text string, ids string, part int, key string")
    found = collections.Counter()
    for r in chunked_bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect():
        found[r.doc_id, bytes(r.ids), bytes(r.decoded)] += 1
    wanted = collections.Counter(
        (i, np.array(LIBRARY.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in TEXTS)
    assert found == wanted


def test_long_pre_tokens_merge_like_short_ones():
    own, rng = chunked_bpe.Ranks(VOCABULARY, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(60):
        word = "".join(rng.choice("abetion ") for _ in range(rng.randint(129, 600))).encode()
        assert own._merge_long(word) == LIBRARY._core_bpe.encode_single_piece(word)


def test_other_vocabulary_and_an_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        other = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for r in chunked_bpe.encode(docs.where("doc_id in (6, 10)"), path, chunk=64, overlap=8).collect():
        text = dict(TEXTS)[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(text)
    assert chunked_bpe.round_trip(docs.where("false"), VOCABULARY).count() == 0


def test_chunks_hold_their_overlap(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    with pytest.raises(ValueError):
        chunked_bpe.encode(docs, VOCABULARY, chunk=8, overlap=9)
    with pytest.raises(ValueError):
        chunked_bpe.encode(docs, VOCABULARY, chunk=8, overlap=3)


def test_short_texts_are_decoded_where_they_are_encoded(spark):
    docs = spark.createDataFrame([(6, "naïve café 漢字 \x85 end"), (7, None)], "doc_id long, text string")
    coded = chunked_bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # short texts, and the decoding of long ones
    apart = chunked_bpe.decode(chunked_bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY,
                               public_tokenizers.PATTERN)
    assert sorted(coded.collect()) == sorted(apart.collect())
