import math
import random

from pyspark.sql import functions as F

from corpusmith.llm import toxicity
from tests.llm.helpers import CLASHES, documents
from tests.oracle import DATA

CLEAN = ["the", "river", "runs", "under", "an", "old", "bridge", "where", "people", "meet", "and", "talk", "about", "weather"]
BAD = ["scoundrelish", "scoundrelly", "scoundrelous", "vermin", "verminous"]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(5, 120))
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def fitted():
    rows = corpus()
    return toxicity.fit([r[1] for r in rows], [r[2] for r in rows])


def test_learns_and_meets_misspellings():
    s = fitted()
    held = corpus(150, seed=9)
    assert sum((s.score(t) >= 0.5) == bool(y) for _, t, y in held) >= 0.97 * len(held)
    assert s.score("the river runs under an old scoundrelisssh bridge") > 0.5 > s.score("the river runs under an old bridge")
    long = " ".join(CLEAN * 3000)
    assert s.score(long) < 0.5 < s.score(long + " vermin " + long)


def test_edges():
    s = fitted()
    assert s.score("") == 0.0 and s.score("... !!") == 0.0
    assert 0 <= s.score("x" * 200_000) <= 1
    assert toxicity.fit(["a"], [1]).score("anything") == 0.0
    assert toxicity.fit([], []).score("anything") == 0.0


def test_frames(spark):
    rows = corpus()
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (3, rows[3][1])], CLASHES)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    s = toxicity.fit_on(docs, labels)
    out = toxicity.with_scores(docs, s, column="toxicity")
    assert out.columns == [*docs.columns, "toxicity"] and out.where("toxicity IS NULL").count() == 0
    kept = toxicity.drop_toxic(docs, s)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.where("doc_id >= 900").collect()} == {900, 901}
    gone = {r.doc_id for r in docs.join(kept.select("doc_id"), "doc_id", "left_anti").collect()}
    toxic = {i for i, _, y in rows if y}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) <= 3
    assert toxicity.drop_toxic(documents(spark, []), s).count() == 0
    assert toxicity.fit_on(docs, labels.limit(0)).score("vermin") == 0.0


def test_folds(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.in_test_fold().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def worst_window(s, text):
    """The score by its definition: n-grams one by one, words as their means, every window."""
    words = [w for k, w in enumerate(toxicity._words(text.lower())) if k == 0 or w != toxicity._words(text.lower())[k - 1]]
    value = lambda w: sum(float(s.values[g]) for g in toxicity.gram_ids([w], len(s.values))[0]) / toxicity.gram_ids([w], len(s.values))[1][0]
    v = [value(w) for w in words]
    n = min(toxicity.WINDOW, len(v))
    top = max(sum(v[i : i + n]) / n for i in range(len(v) - n + 1))
    return 1 / (1 + math.exp(-(top + s.bias)))


def test_scores_by_definition():
    s = fitted()
    for _, t, _ in [*corpus(20, seed=3), (0, "vermin " * 40 + "river", 0), (0, "a", 0)]:
        assert abs(s.score(t) - worst_window(s, t)) < 1e-9


def test_no_row_is_scored_by_its_position_or_columns(spark):
    rows = corpus(60)
    s = fitted()
    out = toxicity.with_scores(documents(spark, [(i, t) for i, t, _ in rows], CLASHES), s)
    assert out.columns.count("score") == 1
    assert {r.doc_id: r.score for r in out.collect()} == {i: s.score(t) for i, t, _ in rows}


def test_null_and_repeated_ids_in_the_stage(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(None, "river vermin bridge"), (None, "river bridge"), (3, ""), (3, None)], CLASHES)
    out = toxicity.toxicity_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert "river bridge" in texts and "river vermin bridge" not in texts and "" in texts and None in texts


def test_query(spark):
    """Held-out recall and precision, which no constant answer reaches."""
    d = f"{DATA}/sf0.1"
    out = toxicity.op1_toxicity(spark, d)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught >= 0.8 * sum(r.toxic for r in rows) and caught >= 0.85 * sum(r.predicted for r in rows)
