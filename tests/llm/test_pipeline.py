"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        w = say(80)
        toxic = i % 8 == 0
        if toxic:
            w[5] = w[40] = rng.choice(["vile", "awful"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    passage = " ".join(say(70))
    rows += [(1000, " ".join(say(20)) + " " + passage), (1001, " ".join(say(30)) + " " + passage + " " + " ".join(say(20)))]
    rows += [(1002, rows[1][1]), (1003, rows[1][1] + " more"), (1004, None), (1005, ""), (1006, "vile awful vile")]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == columns
        docs = docs.cache()
        kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic, near, cut = kept
    assert {i for i in range(400) if i % 8 == 0}.isdisjoint(toxic) and 1006 not in toxic
    assert len(toxic) == 350 + 6  # clean documents stay
    assert set(toxic) - set(near) == {1002, 1003}
    assert set(cut) == set(near) and cut[1000] == near[1000]
    assert len(cut[1001].split()) == 50 and all(cut[i] == near[i] for i in near if i != 1001)
    mixed = corpus_pipeline.mix(spark, docs, corpus)
    assert mixed.columns == columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, corpus)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_run_is_the_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and out.count() > 100


def test_empty_documents(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_model_is_let_go_before_the_next_stage(spark, corpus):
    """What drop_toxic returns holds verdicts, not the scoring with its examples."""
    out = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()


def test_rows_are_judged_by_themselves(spark, corpus, tmp_path):
    """Rows that share a doc_id or lack one, repeated rows, and columns of their own."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    clean = " ".join(f"c{i}" for i in range(80))
    again = " ".join(f"d{i}" for i in range(80))
    more = spark.createDataFrame([(7000, "vile awful vile", "en", "s1", 1), (7000, clean, "en", "s1", 1), (None, "vile vile awful", "en", "s1", 1), (None, clean + " end", "en", "s1", 1), (7001, again, "en", "s1", 1), (7001, again, "en", "s1", 1)], docs.schema)
    rows = docs.unionByName(more).withColumn("row", F.lit(3))
    out = corpus_pipeline.drop_toxic(spark, rows, corpus)
    assert out.columns == rows.columns
    kept = [(r.doc_id, r.text) for r in out.collect() if r.doc_id is None or r.doc_id >= 7000]
    assert sorted(kept, key=str) == sorted([(7000, clean), (None, clean + " end"), (7001, again), (7001, again)], key=str)
    near = corpus_pipeline.drop_near_duplicates(spark, out, corpus)
    assert near.columns == rows.columns
    kept = [(r.doc_id, r.text) for r in near.collect() if r.doc_id is None or r.doc_id >= 7000]
    assert kept in ([(7000, clean), (7001, again)], [(7001, again), (7000, clean)])
