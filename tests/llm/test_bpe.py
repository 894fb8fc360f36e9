import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

from terrafold.llm import blocks, bpe

SCHEMA = "doc_id long, text string, ids int, decoded int, payload string"
PATH = P.path("byte_bpe_50k.tiktoken")


def check(spark, texts):
    ranks = bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, 2, "x")]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN), PATH).collect()
    want = Counter((i, np.asarray(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    odd = ["", None, " ", "a\x1cb \x1f c", "it's we'll  x\n\n\ty", "ünï çödé 日本語 🎉🎉 x", "'s's''", "    　z", "<|endoftext|>", "١٢٣ ½", "a" * 3000, "word " * 2000]
    check(spark, odd + [f"text number {i} of many, the same words again" for i in range(200)])


def test_decode_alone(spark):
    rows = [(1, np.asarray([0, 50255, 7], "<u4").tobytes()), (2, None), (3, b"")]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH).collect()}
    token = {k: w for w, k in bpe.read_ranks(PATH).items()}
    assert got == {1: token[0] + token[50255] + token[7], 2: None, 3: b""}
    import pytest

    with pytest.raises(Exception, match="lacks"):
        bpe.decode(spark.createDataFrame([(1, np.asarray([1 << 20], "<u4").tobytes())], "doc_id long, ids binary"), PATH).collect()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0


def test_digests(spark):
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    row = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first()
    assert got[row.doc_id].decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
