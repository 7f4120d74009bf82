import corpus_pipeline as C
from tracewise.llm import decontaminate, packing, pii, quality
from tracewise.llm.common import materialize

from .helpers import SF, documents


def test_each_stage_works_on_what_the_last_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "personal_data", "best_fit"]
    kept, texts = [{r["doc_id"] for r in docs.collect()}], []
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and docs.schema["text"].dataType == before.schema["text"].dataType
        kept.append({r["doc_id"] for r in docs.collect()})
        assert kept[-1] <= kept[-2]
        if name == "quality_rules":
            assert kept[-1] == {r["doc_id"] for r in quality.assess(before).where("kept").collect()}
        if name == "benchmark_passages":
            clean = decontaminate.find(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(ranges) = 0")
            assert kept[-1] == {r["doc_id"] for r in clean.collect()}
        if name == "personal_data":
            texts = docs.collect()
    assert len(kept[-1]) == len(kept[-2]) and len(kept[2]) < len(kept[1]) < len(kept[0])
    assert not any(pii.base_spans(r["text"]) for r in texts)
    assert all(r["n_chars"] == len(r["text"]) for r in texts)
    rows = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == kept[-1]
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 + 1 for x in packing.packed_ids([r["text"].encode() for r in texts], packing.default_tokenizer_path()))


def test_run_and_awkward_rows(spark, tmp_path):
    assert C.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = documents(spark).withColumnsRenamed({"score": "_quality", "_id": "node"})  # names that operators use
    for name, stage in C.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        assert name == "best_fit" or docs.columns == before.columns
    none = documents(spark, [], extra=False)
    for name, stage in C.STAGES:
        none = materialize(stage(spark, none, SF), name)
    assert none.count() == 0
