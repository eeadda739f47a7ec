import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab '\n\t 　s1é漢!t  "), max_size=200), size=st.integers(1, 20))
def test_cuts_are_safe(text, size):
    enc = bpe.encoding(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    pieces = list(bpe.safe_pieces(text, size))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_query_matches_library(spark, reference):
    texts = [(1, "Hello  world's 123\n\n"), (2, None), (3, ""), (4, "ab " * 50_000 + "é" * 1000), (4, "ab"), (None, "<|endoftext|> 漢字")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as n_tokens")
    got = sorted((tuple(r) for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for doc_id, text in texts:
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_encode_returns_ids(spark, reference):
    row = bpe.encode(spark.createDataFrame([(7, "round trip")], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == reference.encode_ordinary("round trip") and row.decoded == b"round trip"
