"""Each stage acts on what its predecessor kept, and keeps the columns."""

import corpus_pipeline as C
from sparkloom.llm.common import stored, table
from sparkloom.llm.line_quality import op3_line_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for _, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    kept = {r["doc_id"] for r in op3_line_quality(spark, SF).where("kept").collect()}
    assert ids[1] == kept
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4]
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids[4]


def test_run_equals_its_stages(spark):
    a = C.run(spark, SF)
    assert a.count() > 0 and "sequence_id" in a.columns


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0
