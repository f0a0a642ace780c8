import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import alignment
from tests.llm.helpers import CLASHES, documents

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def whole(pair, text):
    """Tokens of a whole text as (id, start, end) by the libraries alone; none where the bytes differ."""
    if not text:
        return [], []
    sides, raw = [], (" " + text).encode()
    for ids, of in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(of[i])))
            at += len(of[i])
        if b"".join(of[i] for i in ids) != raw:
            return [], []
        sides.append(tokens)
    return sides


def brute(pair, rows):
    sides = [(i, *whole(pair, t)) for i, t in rows]
    linked = []
    for _, a, b in sides:
        linked.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
    counts = Counter(p for links in linked for p in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (i, a, b), links in zip(sides, linked, strict=True):
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(x[0]) for x in a if start < x[2] <= c) + "|" + ",".join(str(x[0]) for x in b if start < x[2] <= c))
            start = c
        text = ";".join(groups)
        out.append((i, len(a), len(b), len(cuts), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


NASTY = ["a", "B", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "́", "漢", "🎉", "<|endoftext|>", "<s>", "<0x41>", "1", "²", "ß", "!?", "_", " ", "\x1c", "\x85", "　", "\0", "�", "ther", "ing", "ⅷ", "-", "\r\n", "ﬁ", "Ａ"]


def test_segments_give_the_tokens_of_the_whole(pair):
    rng = random.Random(3)
    texts = ["".join(rng.choice(NASTY) for _ in range(rng.randint(1, 14))) for _ in range(6000)] + [f"a{chr(c)}b {chr(c)} .{chr(c)}." for c in range(0x3100) if chr(c) != "▁"]
    words = ["the", "e.g.", "3.14,", "it's", "(so)", "été", "x.", "a,b", "..", "²x", "A1;", "ﬁn!", "_y:", "漢", "?", "🎉."]
    texts += [rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 8))) + rng.choice(["", "", " ", "\n"]) for _ in range(4000)]
    for t in filter(None, texts):
        segments = alignment.segments_of(t)
        assert "".join(segments) == " " + t and len(segments) <= len(alignment.CUT.split(" " + t))
        a, b = pair.encode(segments)
        assert [i for x in a for i in x] == pair.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        assert [i for x in b for i in x] == pair.b.encode(t), repr(t)
        assert all(pair.joined(*x) for x in zip(segments, a, b, strict=True))


def test_against_brute_force(spark, pair):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "a▁b the"), (1003, "the the the the"), (1004, "x" * 4000), (1005, " "), (1006, "  a  "), (1007, "the"), (1008, "漢字" * 300)]
    docs = documents(spark, rows, [*CLASHES, ("block", "x"), ("seq", "x"), ("number", "x"), ("segment", "x"), ("end", "x"), ("side", "x")])
    assert rows_of(alignment.align_documents(docs, A, B)) == brute(pair, rows)


def test_blocks_may_be_small_and_counts_large(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 30)
    monkeypatch.setattr(alignment, "SENT_PAIRS", 0)
    rows = [(None, "the cat. The cat"), (None, "the cat. The cat"), (4, "the mat, unbelievable"), *((i, f"ceneau {i} theing") for i in range(5, 60))]
    docs = documents(spark, rows).repartition(5)
    with alignment.arrow_batches(spark):
        assert rows_of(alignment.align_documents(docs, A, B)) == brute(pair, rows)


def test_empty_table_and_settings(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    out = alignment.align_documents(documents(spark, []), A, B)
    assert out.collect() == [] and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_align_of_any_tokens(spark):
    """A group of many tokens on both sides has as many links as ends."""
    n = 3000
    a, b = [(0, i, 2) for i in range(n)] + [(0, 7, 1)], [(1, 9, 1)] + [(1, i, 2) for i in range(n)]
    df = spark.createDataFrame([(1, a + b), (2, [(0, 5, 3), (1, 6, 3)]), (3, [])], "doc long, tokens array<struct<side:int,id:int,bytes:int>>")
    got = {r.doc: r for r in alignment.align(df).collect()}
    assert set(got) == {1, 2} and got[2].groups == "5|6" and [tuple(x) for x in got[2].links] == [(5, 6)]
    assert got[1].n_groups == 1 and len(got[1].links) == 2 * n + 1 and got[1].groups.count(",") == 2 * n


def test_query(spark, pair):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(alignment.op11_alignment(spark, sf))
    sides = {i: whole(pair, t) for i, t in rows}
    for r in got:
        a, b = sides[r[0]]
        ends = {x[2] for x in a} | {x[2] for x in b}
        assert r[1:5] == (len(a), len(b), len({x[2] for x in a} & {x[2] for x in b}), len(ends))
    assert len(got) == len(rows) and spark.createDataFrame([(x[6],) for x in got], "n long").agg(F.sum("n")).first()[0] > 0
