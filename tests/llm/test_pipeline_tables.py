"""The pipeline's decontamination: the rows that contamination() hits, with few tables and broadcasts on the driver's account."""

from sparkfolio.llm import decontamination, storage


def test_hit_rows_are_those_with_hits_and_few_tables_are_written(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    item = " ".join(f"w{chr(97 + k)}" for k in range(14))
    texts = [item, f"x {item[6:]} y", f"x {item[:20]} y", "Short One", "short two one", None, "", f"{item} {item}", "one short one"]
    docs = spark.createDataFrame([(i, x, "en", "a") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "...")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(r.doc_id for r in decontamination.contamination(docs, bench).filter("n_hit > 0").collect())
    assert want == [0, 1, 3, 7, 8]
    made, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda session, name: (made.append(name), new_path(session, name))[1])
    left = sorted(r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect())
    assert left == [i for i in range(len(texts)) if i not in want]
    assert len(made) <= 7, made
