import random

import numpy as np
import pytest
from cases import DOCS_SCHEMA, docs

from seqloom.llm.tokens import CHUNK, Encoder, count_tokens

PIECES = ["a", "bc", " ", "  ", "\n", "'s", "<|endoftext|>", "<|end", "é", "漢字", "1", "!!", " \t", "x" * 50, "of the ", "\xa0", "\x85", "\x1c", "İ", "​"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder.of("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def fast():
    """As packing takes it: Latin-1 texts by the rank file."""
    return Encoder.of("byte_bpe_50k.json", fast=True)


def library(encoder, text):
    return np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_equal_to_the_library(encoder, fast):
    rnd = random.Random(5)
    for _ in range(300):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))
        assert encoder.ids(t) == fast.ids(t) == library(encoder, t), t
    latin = [chr(i) for i in range(256)]
    for _ in range(500):
        t = "".join(rnd.choice(latin) for _ in range(rnd.randint(1, 200)))
        assert fast.ids(t) == library(encoder, t), t


def test_equal_to_the_library_on_the_corpora(encoder, fast):
    import pyarrow.parquet as pq

    spliced = 0
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        want = library(encoder, t or "")
        assert encoder.ids(t or "") == want == fast.ids(t or "", chunk=1 << 20)
        spliced += len(t or "") > CHUNK
    assert spliced >= 20


def test_resynchronised_chunks(encoder):
    rnd = random.Random(6)
    for _ in range(200):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(50, 400)))
        assert encoder.ids(t, rnd.randint(20, 100), rnd.randint(2, 20)) == library(encoder, t), t
    for t in ("x" * 5000, " " * 5000, "a b" * 3000, "\n" * 3000 + "x", "!" * 4000, "<|endoftext|>" * 500):
        assert encoder.ids(t, 100, 8) == library(encoder, t)


def test_counts(spark, encoder):
    texts = [None, "", "a", "é" * 10, "word " * 1100, "<|endoftext|>x", "z " * 40_000]
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame(docs(texts), DOCS_SCHEMA)).collect()}
    for i, t in enumerate(texts):
        n = len(library(encoder, t or "")) // 4
        assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 1024)
