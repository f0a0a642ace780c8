import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import bpe
from tests.llm.helpers import CLASHES, documents

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)


def test_chunks_meet_everywhere(codec):
    rng = random.Random(3)
    for _ in range(400):
        alphabet = rng.choice(["ab 1'", " \n a", "é　 .x's", "   ", "\n\t ", "aaaa", "🎉a 1.\r\n"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        for chunk, overlap in ((16, 4), (7, 1), (64, 8)):
            assert [p for run in bpe.pretokenise(text, codec.findall, chunk, overlap) for p in run] == codec.findall(text)
            assert codec.encode(text, chunk, overlap) == codec.encoding.encode_ordinary(text)


def test_round_trip_and_digests(spark, codec):
    texts = ["", None, "hello world", "héllo\n\n  wörld 🎉", "a" * 200_000, "word " * 60_000, "<|endoftext|>", " " * 70_000 + "x"]
    docs = documents(spark, list(enumerate(texts)), CLASHES)
    out = bpe.encode_documents(docs, RANKS, P.PATTERN, with_ids=True)
    decoded = {r.doc_id: bytes(r.bytes) for r in bpe.decode_ids(out, RANKS, P.PATTERN).collect()}
    for r in out.collect():
        text = texts[r.doc_id] or ""
        ids = codec.encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids) and list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert decoded[r.doc_id] == text.encode() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_null_id_and_repeats(spark):
    assert bpe.encode_documents(documents(spark, []), RANKS, P.PATTERN).count() == 0
    rows = bpe.encode_documents(documents(spark, [(None, "a"), (1, "b"), (1, "b")]), RANKS, P.PATTERN).collect()
    assert len(rows) == 3 and sum(r.doc_id is None for r in rows) == 1


def test_stage_keeps_every_document(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)])
    assert bpe.bpe_stage(spark, docs, "").agg(F.countDistinct("doc_id")).first()[0] == 20
