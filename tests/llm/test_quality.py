import collections
import zlib

import numpy as np

import corpus_pipeline
from pathclear.llm import jaccard, packing, quality, queries, secrets
from tests.llm import rows as R
from tests.llm.test_near import classes

WHERE = "/root/testdata/sf0.01"


def test_held_out_rows_are_told_right(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{WHERE}/labels.parquet").collect()}
    got = queries.op7_quality(spark, WHERE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert above > 0.98 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.97


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'y' as source", "0 as n_chars")
    assert sorted(quality.score(docs, labels).collect()) == sorted(quality.score(other, turned).collect())


def test_edge_rows_are_scored(spark):
    docs = R.frame(spark)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(100, 125)] + [(None, 1, 0), (7, None, 0), (7, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(R.texts()) and all(0 <= r.score <= 1 for r in got)
    same = collections.defaultdict(set)
    for r in got:
        same[r.doc_id].add(r.score)
    assert len(same[1] | same[2] | same[3]) == 1  # null, empty and blank texts have no words
    assert all(r.predicted == 1 for r in quality.score(docs, labels.limit(0)).collect())
    assert quality.score(R.empty(spark), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_temperature_and_weights_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 10))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    network = quality.fit(x, y)
    assert np.mean((network.scores(x) >= 0.5) == y) > 0.95 and network.temperature > 0


def test_pipeline_stages(spark):
    """Each stage against what its operator finds in the stage's own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality"]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in quality.score(before, labels).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == good
    before, after = seen["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want, n = classes(rows)
    assert {r.doc_id for r in after.collect()} == {c for _, c, _ in want} and after.count() == n
    before, after = seen["secrets"]
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        assert not [s for s in secrets.find(texts[r.doc_id].text) if s[0] != "assign"]
        assert texts[r.doc_id].n_chars == len(texts[r.doc_id].text) and (secrets.find(r.text) or texts[r.doc_id] == r)
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert max(sum(x.length for x in after.collect() if x.sequence_id == s) for s in range(3)) <= 4096


def test_stages_bear_edge_rows(spark):
    docs = R.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    assert jaccard.one_of_each(docs).count() == classes(R.texts())[1]
    assert corpus_pipeline.redacted_documents(spark, docs, WHERE).count() == len(R.texts())
    assert packing.pack_documents(docs, queries.WORD_TOKENIZER).count() >= len(R.texts())
