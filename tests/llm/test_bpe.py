import hashlib
import random

import numpy as np
import pytest
import tiktoken
from llm_cases import edge_docs, edge_rows, empty_docs

from pagefold.llm import bpe


@pytest.fixture(scope="module")
def both():
    path, pattern = bpe.default_vocabulary()
    c = bpe.Codec(path, pattern)
    return c, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})


def test_ids_equal_the_library(both):
    c, library = both
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x2FFF), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice("aab the\n\t  　\x1c\x85!!'s") for _ in range(50)) for _ in range(200)]
    texts += ["a" * 2000, "", " ", "1234567890" * 30, "<|endoftext|>", *(t or "" for _, t, _, _ in edge_rows())]
    for text, ids in zip(texts, c.encode_bytes(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert c.decode_bytes(ids) == text.encode()


def test_forgetting_changes_nothing(both, monkeypatch):
    c, library = both
    monkeypatch.setattr(bpe, "KEPT_BYTES", 0)
    texts = [t or "" for _, t, _, _ in edge_rows()] * 2
    assert [np.frombuffer(b, "<u4").tolist() for b in c.encode_bytes(texts)] == [library.encode_ordinary(t) for t in texts]


def test_digests_and_columns(spark, both):
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.encoding_digests(edge_docs(spark)).collect()}
    for doc_id, text, _, _ in edge_rows():
        ids = both[1].encode_ordinary(text or "")
        r = got[doc_id, hashlib.sha256((text or "").encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encoding_digests(empty_docs(spark)).collect() == []


def test_encode_decode_round_trip(spark):
    df = edge_docs(spark)
    df = df.withColumn("ids", bpe.encode(df["text"]))
    for r in df.withColumn("back", bpe.decode(df["ids"])).select("text", "back").collect():
        assert bytes(r.back).decode() == (r.text or "")
