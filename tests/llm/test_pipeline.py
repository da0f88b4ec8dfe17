import pytest

import corpus_pipeline


def test_stages(spark, sf):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == first.columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(kept & toxic) <= 0.1 * len(toxic) + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    assert sizes["toxicity"] < first.count() and sizes["near dedup"] <= sizes["line dedup"] and sizes["packing"] >= sizes["mixing"]


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_shortest_pack_first", "op8_entropy_balancing"])
def test_queries_are_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and "pipeline" in __spark_entry__.queries()
