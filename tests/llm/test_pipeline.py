"""The pipeline's stages, each on what its predecessor kept."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from tallyframe.llm import jaccard, repeats


from .conftest import sentence
from .test_operators import brute_jaccard, brute_repeats, check_packed

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        kept[name] = (before, docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = kept["quality"]
    good = before.join(labels.where("quality = 1"), "doc_id")
    bad = before.join(labels.where("quality = 0"), "doc_id")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.05 * good.count()
    assert bad.join(after, "doc_id").count() <= 0.2 * bad.count() + 1
    before, after = kept["language"]
    assert after.count() >= 0.98 * before.count()
    before, after = kept["near_copies"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {c for _, _, c in brute_jaccard(rows)}
    before, after = kept["repeats"]
    gone, _ = brute_repeats([(r["doc_id"], r["text"]) for r in before.collect()])
    words = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}
    cut = {k[1]: len(v) for k, v in gone.items()}
    assert {r["doc_id"]: len(r["text"].split()) for r in after.collect()} == {
        k: n - cut.get(k, 0) for k, n in words.items() if n - cut.get(k, 0)}
    before, after = kept["packing"]
    check_packed(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()])


def test_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "score", "key", "ids")
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
    ids = [r["doc_id"] for r in P.keep_first_of_near_copies(spark, docs, SF).collect()]
    assert sorted(ids, key=lambda x: -1 if x is None else x) == [None, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 15]
    none = docs.where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert jaccard.WORDS == 5 and repeats.LENGTH == 50


def test_near_copies_keep_every_other_text(spark):
    rnd = random.Random(9)
    a, b, c = (sentence(rnd, 80) for _ in range(3))
    near = " ".join([*a.split()[:70], "end", *a.split()[70:]])
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (None, c), (5, c), (None, near), (7, None), (8, ""), (None, None), (3, sentence(rnd, 80)), (None, "only here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.keep_first_of_near_copies(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (5, c), (7, None), (8, ""), (None, None), rows[12], rows[13]], key=str)


def test_copies_without_a_number_leave_one(spark):
    rnd = random.Random(10)
    texts = [sentence(rnd, 60) for _ in range(40)]
    docs = spark.createDataFrame([(None, t, "en", "s", 1) for t in texts for _ in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in P.keep_first_of_near_copies(spark, docs, SF).collect()) == sorted(texts)
