"""The pipeline against its stages run one after another on plain lists."""

import __spark_entry__ as entry
import corpus_pipeline
from lumenprose.llm import anchors, bagminhash, quality, toxicity

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "substring_dedup", "packing"]
    grammar = toxicity.learn(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect() if grammar.score(r.text or "") < toxicity.THRESHOLD}
    clean = docs.filter(docs.doc_id.isin(list(rows)))
    good = {r.doc_id for r in quality.score(clean, quality.learn(clean, labels)).filter(f"score >= {quality.THRESHOLD}").collect()}
    left = clean.filter(clean.doc_id.isin(list(good)))
    kept = {r.class_id for r in bagminhash.classes(left).collect()}
    texts = sorted((d, t) for d, t in rows.items() if d in kept)
    cut = anchors.brute_force(texts)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == {d for d, (n, gone, _) in cut.items() if not n or gone < n}
    by_seq = {}
    for r in got:
        by_seq[r.sequence_id] = by_seq.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 and n <= 1024 for n in by_seq.values())


def test_registered():
    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
