import numpy as np

import __spark_entry__
import corpus_pipeline
from tidemesh.llm import bt_quality, content_dedup
from tidemesh.llm.packing import CAPACITY, padding
from tidemesh.llm.similar import shingles, similar

D = "/root/testdata/sf0.001"


def least_of_components(docs):
    """By comparing all pairs: texts link if 0.8 of their five-word shingles are common; the least id of each component stays."""
    rows = sorted(((r["doc_id"], shingles((r["text"] or "").encode())) for r in docs.collect()), key=lambda x: x[0])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if similar(rows[a][1], rows[b][1]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [rows[k][0] for k in range(len(rows)) if find(k) == k]


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    for name in ("quality", "exact", "near", "mix"):
        assert seen[name][1].columns == columns

    def ids(df):
        return sorted(r[0] for r in df.select("doc_id").collect())

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    scored = bt_quality.classify(before, bt_quality.fit(before, labels))
    assert ids(after) == ids(scored.filter("predicted = 1")) and 0 < after.count() < before.count()
    before, after = seen["exact"]
    assert ids(after) == ids(content_dedup.exact_groups(before).filter("kept"))
    before, after = seen["near"]
    assert ids(after) == least_of_components(before)
    before, after = seen["pack"]
    assert set(ids(after)) == set(ids(before))
    used = after.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert used.max() <= CAPACITY and sum(map(padding, used)) / used.sum() < 0.05
    assert all(len(r["ids"]) == 4 * r["length"] for r in after.collect())


def test_run_and_registration(spark):
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, D)
    assert np.all(np.array([r["length"] for r in out.select("length").collect()]) > 0)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0
