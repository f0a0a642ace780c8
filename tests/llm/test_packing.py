import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from corpusmith.llm import packing
from tests.llm.helpers import CLASHES, documents

PATH = P.path("word_bpe_49k.json")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def words():
    return packing.Words(PATH)


def plain_ids(words, text):
    return words.tokenizer.encode(text or "", add_special_tokens=False).ids


def held(rows, texts, words, capacity=packing.CAPACITY):
    """Rows of distinct doc_ids against texts: each id in one piece, digests right, sequences gapless and within the capacity. The padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = [*plain_ids(words, text), packing.END_ID], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    wasted = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        wasted += packing.padding(at, capacity)
    assert set(by_sequence) == set(range(len(by_sequence)))
    return wasted


def test_ids_are_the_tokenizers(words):
    rng = random.Random(5)
    parts = ["'s", "'RE", " ", "\n", "\x1c", "\xa0", "é", "É", "é", "́", "Σ", "ß", "1", "23", "²", "½", "...", "<|endoftext|>", "<|", "The", "ª", "µ", "İ", "漢", "🎉", "_", " ", "\0", "ÿ", "×"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert words.ids(text) == np.array(plain_ids(words, text), "<u4").tobytes(), text
    for c in range(0x3100):
        text = f"aB{chr(c)}c {chr(c)}"
        assert words.ids(text) == np.array(plain_ids(words, text), "<u4").tobytes(), text


def test_memory_of_words_may_be_small(words, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    fresh = packing.Words(PATH)
    for text in ("a b c d e", "漢 b c d", "f g h i", "a b"):
        assert fresh.ids(text) == np.array(plain_ids(words, text), "<u4").tobytes()


def test_a_window_is_as_full_as_any_choice():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([16, 20, 31])
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        took = packing.fill(dict(Counter(pieces)), capacity)
        assert not Counter(took) - Counter(pieces) and max(pieces) in took
        rest = sorted(pieces)
        longest = rest.pop()
        sums = {longest + sum(x) for k in range(len(rest) + 1) for x in itertools.combinations(rest, k)}
        assert packing.padding(sum(n * k for n, k in took.items()), capacity) == min(packing.padding(s, capacity) for s in sums if s <= capacity)


def test_plan_places_every_piece_and_stays_small():
    rng = random.Random(4)
    counts = Counter(int(rng.lognormvariate(5, 1.3)) % 2048 + 1 for _ in range(20_000))
    many = {n: k * 1_000_003 for n, k in counts.items()}
    for c in (dict(counts), many, {2048: 7}, {1: 3}, {2000: 10**12, 48: 5}, {}):
        windows = packing.plan_windows(c)
        placed = Counter()
        for times, took in windows:
            assert times > 0 and sum(n * k for n, k in took.items()) <= 2048
            for n, k in took.items():
                placed[n] += times * k
        assert placed == Counter(c) and len(windows) <= 2 * 2048 + 20


def test_edges(spark, words):
    texts = {0: None, 1: "", 2: "a", 3: "word " * 9000, 4: "x" * 30_000, 5: "漢字 " * 500, 6: "same", 7: "same", 8: "  \n "}
    docs = documents(spark, list(texts.items()), [*CLASHES, ("length", "x"), ("start", "x"), ("block", "x"), ("nth", "x"), ("rank", "x")])
    held(packing.pack_documents(docs, PATH).collect(), texts, words)
    out = packing.pack_documents(documents(spark, []), PATH)
    assert out.collect() == [] and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    repeated = packing.pack_documents(documents(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), PATH).collect()
    assert len(repeated) == 3 and len({(r.sequence_id, r.offset) for r in repeated}) == 3 and sum(r.doc_id is None for r in repeated) == 1


def test_small_capacity_over_many_partitions(spark, words):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["the", "cat", "sat"]) for _ in range(rng.randint(0, 90))) for i in range(400)}
    docs = documents(spark, list(texts.items())).repartition(7)
    rows = packing.pack_documents(docs, PATH, capacity=64).collect()
    assert held(rows, texts, words, 64) <= 0.01 * sum(r.length for r in rows)


def test_query(spark, words):
    sf = "/root/testdata/sf0.001"
    rows = packing.op13_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert held(rows, texts, words) <= 0.02 * sum(r.length for r in rows)
