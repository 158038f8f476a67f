from collections import defaultdict

import corpus_pipeline
from cases import collected, edge_rows, frame
from graphloom.llm import bpe, classifier, exact, mixing, simhash
from test_texts import VOCABULARY, simhash_expected


def test_stages_one_by_one(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    docs = documents
    text = {r.doc_id: r.text for r in documents.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.schema == documents.schema and docs.subtract(documents).count() == 0
        seen.append((name, {r.doc_id for r in before.collect()}, {r.doc_id for r in docs.collect()}))
    (_, _, good), (_, _, single), (_, _, far), (_, _, drawn) = seen
    assert good == {r.doc_id for r in classifier.quality_scores(documents, labels).where("predicted = 1").collect()}
    keep = defaultdict(int)
    for i in good:
        keep[text[i]] = max(keep[text[i]], i)
    assert single == set(keep.values())
    assert far == {i for i, _, c in simhash_expected([(i, text[i] or "") for i in single]) if i == c}
    left = documents.where(documents.doc_id.isin(list(far)))
    assert drawn == {r.doc_id for r in mixing.mix(left).where("kept").collect()}
    final = collected(corpus_pipeline.run(spark, sf_dir))
    assert final == collected(bpe.encode_documents(documents.where(documents.doc_id.isin(list(drawn))), VOCABULARY))


def test_stages_on_edge_rows(spark, sf_dir):
    kept = exact.keep_one(frame(spark)).collect()
    pairs = [(r[0], r[1] or "") for r in edge_rows()]
    assert sorted(r.text or "" for r in kept) == sorted({t for i, t in pairs if i is not None})
    near = simhash.keep_one(frame(spark))
    component = {(i, fp): c for i, fp, c in simhash_expected(pairs)}
    prints = {t: next(fp for _, fp, _ in simhash_expected([(0, t)])) for _, t in pairs}
    wanted = {(i, t) for i, t in pairs if component[i, prints[t]] == i}
    assert sorted(((r.doc_id, r.text or "") for r in near.collect()), key=repr) == sorted(wanted, key=repr)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = classifier.keep_good(frame(spark), labels, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert good.schema == frame(spark).schema and good.subtract(frame(spark)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), sf_dir).count() == 0

