import corpus_pipeline
from corpusmith.llm import bpe, decontaminate, lines, minhash, toxicity  # noqa: F401
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.helpers import documents
from tests.oracle import DATA

D = f"{DATA}/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    scorer = toxicity.fit_on(docs, spark.read.parquet(f"{D}/labels.parquet"))
    one = stages["toxicity"](spark, docs, D)
    assert one.columns == docs.columns
    kept = {i for i, t in rows(docs) if scorer.score(t) < 0.5}
    assert {i for i, _ in rows(one)} == kept

    two = stages["line_dedup"](spark, one, D)
    want = brute_lines(rows(one))
    before = dict(rows(one))
    assert two.columns == docs.columns
    assert dict(rows(two)) == {i: t for i, t in want.items() if t.strip(" \n") or t == before[i]}

    three = stages["minhash_near_dedup"](spark, two, D)
    near = brute_near(rows(two), 5)
    assert {i for i, _ in rows(three)} == {i for i, (_, _, k) in near.items() if k}

    four = stages["benchmark_decontamination"](spark, three, D)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute_leaks(rows(three), items)}
    assert {i for i, _ in rows(four)} == {i for i, _ in rows(three)} - bad

    five = stages["byte_level_bpe"](spark, four, D)
    assert {r.doc_id for r in five.collect()} == {i for i, _ in rows(four)}


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0


def test_stages_decide_by_row(spark, tmp_path):
    t = " ".join(f"w{i}" for i in range(60))
    clean, other, third = "something else entirely", "a clean text of its own", "one more text that nobody copies"
    near = [(3, t), (3, clean), (3, clean), (1, other), (1, t + " end"), (None, third), (None, third), (None, t + " at"), (None, None), (None, ""), (5, clean)]
    out = rows(minhash.minhash_stage(spark, documents(spark, near), ""))
    assert sorted(out, key=str) == sorted([(3, clean), (1, other), (1, t + " end"), (None, third), (None, None), (None, "")], key=str)

    spark.createDataFrame([(1, t)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = [(None, t), (None, clean), (4, "x " + t), (4, clean), (4, clean), (6, other), (7, None)]
    out = rows(decontaminate.decontamination_stage(spark, documents(spark, leak), str(tmp_path)))
    assert sorted(out, key=str) == sorted([(None, clean), (4, clean), (4, clean), (6, other), (7, None)], key=str)
