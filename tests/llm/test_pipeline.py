"""The five stages on the smallest tables, each held against what its operator says."""

import corpus_pipeline
from deltaweave.llm import decontaminate, near_dedup, packing
from deltaweave.llm.shared import materialize, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, FOLDER))
        assert after.columns == docs.columns and after.join(docs, "doc_id", "left_anti").isEmpty()
        kept[name], docs = (docs, after), after
    before, after = kept["near duplicates"]
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == set(classes.values())
    before, after = kept["decontamination"]
    clean = decontaminate.find_leaks(before, table(spark, FOLDER, "benchmark")).where("leaks.n_hit = 0")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in clean.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in docs.collect()}
    assert pieces.groupby("doc_id")["length"].sum().equals(pieces.groupby("doc_id")["doc_tokens"].first().rename("length"))
    assert pieces.groupby("sequence_id")["length"].sum().max() <= packing.WINDOW


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for name in ("documents", "labels", "benchmark"):
        table(spark, FOLDER, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
