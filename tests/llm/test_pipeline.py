from __future__ import annotations


import corpus_pipeline
from quantspark.llm.common import table, written
from quantspark.llm.mixing import mix
from quantspark.llm.suffixes import removal_report

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    """Each stage on what its predecessor kept; the result is that of run()."""
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append(docs)
    start, clean, single, cut, mixed = kept
    assert 0 < clean.count() < start.count() and single.count() < clean.count()
    assert single.join(clean, columns, "left_anti").count() == 0
    left = {r.doc_id: r.n_bytes - r.n_removed for r in removal_report(single).collect()}
    for r in cut.collect():
        assert r.n_chars == len(r.text) and left[r.doc_id] - 6 <= len(r.text.encode()) <= left[r.doc_id]
    copies = {r.doc_id: r.copies for r in mix(cut).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    pieces = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert pieces.select("doc_id").distinct().count() == len(copies)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(map(str, pieces.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))
