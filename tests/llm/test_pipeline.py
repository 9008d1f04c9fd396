"""The pipeline's stages: columns kept, decisions in effect, every kept text packed."""

from sitegrain.llm import packing


def test_stages(spark, docs, texts, tmp_path):
    import corpus_pipeline as C

    rows = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in C.STAGES] == ["quality", "near", "repeats", "secrets", "packing"]
    now, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == rows.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert len(counts["quality"]) == len(texts)  # all labels are good
    assert len(counts["near"]) < len(texts) - 20 and set(counts["repeats"]) == set(counts["near"])
    passage = texts[24][1].split(" ", 60)[60][:400]
    assert any(passage in (t or "") for t in counts["near"].values()) and not any(passage in (t or "") for t in counts["repeats"].values())
    packed = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(counts["secrets"]) and all(r["length"] <= packing.CAPACITY for r in packed)
