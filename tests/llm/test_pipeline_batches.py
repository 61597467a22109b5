import pytest

import corpus_pipeline


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_hold_few_texts_at_once(spark, tmp_path, stage):
    session = spark.newSession()
    reader, rows, size = corpus_pipeline.BATCHES
    session.conf.set(rows, "77")
    docs = session.createDataFrame([(i, f"some words and more of them {i}", "en", "web", 30) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    session.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage(session, session.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert int(session.conf.get(reader)) <= 256 and session.conf.get(size) == "4m"
    assert session.conf.get(rows) == "77"  # the caller's own
