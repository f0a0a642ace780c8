import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmith.functions import text as X
from corpusmith.operators import bleu
from corpusmith.plans.relational import QUERIES
from tests.oracle import DATA

H1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
R1A = "It is a guide to action that ensures that the military will forever heed Party commands"
R1B = "It is the guiding principle which guarantees the military forces always being under the command of the Party"
R1C = "It is the practical guide for the army always to heed the directions of the party"
H2 = "he read the book because he was interested in world history"
R2 = "he was interested in world history because he read the book"


def stats(spark, rows, keywords=None, orders=4):
    df = spark.createDataFrame([(i, h.split(), [r.split() for r in rs]) for i, (h, rs) in enumerate(rows)], "id int, h array<string>, r array<array<string>>")
    return bleu.with_stats(df, "h", "r", orders=orders, keywords=keywords)


def test_bleu_b(spark):
    s = stats(spark, [(H1, [R1A, R1B, R1C]), (H2, [R2])])
    assert bleu.sums(s, bleu.closest()).select(bleu.bleu_b()).first()[0] == pytest.approx(0.5920778868801042, abs=1e-12)
    each = [r[0] for r in bleu.sums(s, bleu.closest(), ("id",)).orderBy("id").select(bleu.bleu_b()).collect()]
    assert sum(each) / 2 == pytest.approx(0.6223247442490669, abs=1e-12)


def test_clipped_precision_and_brevity(spark):
    hit, guess, *_ = bleu.row_stats(["the"] * 7, ["the cat is on the mat".split(), "there is a cat on the mat".split()])
    assert hit[0] / guess[0] == pytest.approx(0.2857142857142857)
    one = spark.range(1).select(bleu.brevity_penalty(F.lit(12.0), F.lit(28.0)), bleu.brevity_penalty(F.lit(0.0), F.lit(5.0)), bleu.brevity_penalty(F.lit(6.0), F.lit(5.0))).first()
    assert one[0] == pytest.approx(0.2635971381157267) and one[1] == 0 and one[2] == 1


def test_bleu_a(spark):
    s = bleu.sums(stats(spark, [(H1, [R1A]), (H2, [R2])]), bleu.shortest())
    row = s.select(bleu.bleu_a(), bleu.bleu_a(smooth=False), "h1", "h2", "h3", "h4", "g1", "g2", "g3", "g4", "hyp", "ref").first()
    assert row[0] == pytest.approx(0.55135406615592, abs=1e-12) and row[1] == pytest.approx(0.5314082679468591, abs=1e-12)
    assert list(row[2:]) == [22, 17, 12, 8, 29, 27, 25, 23, 29, 27]
    assert bleu.sums(stats(spark, [(R2, [R2])]), bleu.shortest()).select(bleu.bleu_a()).first()[0] == pytest.approx(1.0)


def test_bleu_c(spark):
    s = stats(spark, [(H1.lower(), [R1A.lower()]), (H2, [R2])])
    got = [r[0] for r in bleu.sums(s, bleu.shortest(), ("id",)).orderBy("id").select(bleu.bleu_c()).collect()]
    assert got == pytest.approx([0.455087043756333, 0.7710955777402455], abs=1e-12)


def test_smoothing_methods(spark):
    s = bleu.sums(stats(spark, [("the cat sat here today now", ["the cat ran there today then"])], orders=5), bleu.closest(), orders=5)
    scores = [s.select(bleu.bleu_b(m)).first()[0] for m in range(8)]
    assert all(x is not None and 0 <= x < 1 for x in scores)
    assert scores[0] < 1e-60 < scores[1] < scores[2]
    assert scores[3] != scores[4]


def test_empty_texts(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], [[]])], "id int, h array<string>, r array<array<string>>")
    s = bleu.sums(bleu.with_stats(df, "h", "r"), F.lit(0))
    assert s.select(bleu.bleu_b(), bleu.bleu_a()).first()[0] == 0


def test_weighted_recall(spark):
    s = bleu.sums(stats(spark, [("a b", ["a c"])], keywords=frozenset(["a"])), bleu.closest())
    row = s.select("rh1", "ra1", "rh2", "ra2").first()
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(1.2) and row[2:] == (0, 1)


def test_mteval_tokens(spark):
    t = "It's 3.5, no-\nwhere &quot;x&quot; (a) 4-5."
    df = spark.createDataFrame([(t,)], "t string").select(X.mteval_tokens(F.col("t")), X.split_punctuation(F.col("t")), X.subtokens(F.lit("parseHTTPFile_2go")))
    a, b, c = df.first()
    assert a == ["it's", "3.5", ",", "nowhere", '"', "x", '"', "(", "a", ")", "4", "-", "5", "."]
    assert b.startswith("It ' s 3 . 5 , no - where")
    assert c == ["parse", "HTTP", "File", "2", "go"]


def test_gram_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), [rng.choice("abcé") for _ in range(rng.randint(0, 9))]) for _ in range(80)] + [("z", ["a", "b"]), ("z", []), ("z", None), ("w", None), (None, ["a"])]
    want = {}
    for lang, tokens in rows:
        for n in range(1, 5):
            for i in range(len(tokens or []) - n + 1):
                want.setdefault((lang, n), Counter())[tuple(tokens[i : i + n])] += 1
    df = spark.createDataFrame(rows, "lang string, t array<string>").repartition(3)
    got = {(r.lang, r.n): (r.distinct_grams, r.grams, r.most) for r in bleu.gram_counts(df, "t", ("lang",)).collect()}
    assert got == {k: (len(c), c.total(), max(c.values())) for k, c in want.items()}
    two = bleu.gram_counts(df.where("lang in ('x', 'y')"), "t", orders=2).collect()
    whole = [want["x", n] + want["y", n] for n in (1, 2)]
    assert [(r.n, r.distinct_grams, r.grams, r.most) for r in two] == [(n, len(c), c.total(), max(c.values())) for n, c in enumerate(whole, 1)]


def test_gram_counts_read_a_text_once(spark):
    plan = QUERIES["ngram_counts"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_gram_counts_take_little_disk(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        found = files.getAllFiles()
        return {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size()))}

    before = kept()
    assert QUERIES["ngram_counts"](spark, f"{DATA}/sf0.01").count() == 16
    added = sum(size for name, size in kept().items() if name not in before)
    assert 0 < added < 4 * os.path.getsize(f"{DATA}/sf0.01/documents.parquet")


def test_few_rows_of_a_batch_are_objects_at_once(spark, monkeypatch):
    at_once, runs, cut = [], [], bleu._lists
    monkeypatch.setattr(bleu, "_lists", lambda a: at_once.append(len(a)) or cut(a))
    monkeypatch.setattr(bleu.F, "arrow_udf", lambda f, kind: runs.append(f) or (lambda *columns: F.lit(None)))
    bleu.with_stats(spark.createDataFrame([([], [])], "h array<string>, r array<array<string>>"), "h", "r")
    texts = [[f"w{i}", "x"] for i in range(1000)]
    stats = runs[0](pa.array(texts), pa.array([[t] for t in texts])).to_pylist()
    assert len(stats) == 1000 and {tuple(r["hit"]) for r in stats} == {(2, 1, 0, 0)} and max(at_once) <= bleu.TOGETHER
