from retrievo.sources import embedding_cache


def test_texts_are_not_staged(spark, tmp_path, monkeypatch):
    seen, stage = [], embedding_cache.stage
    monkeypatch.setattr(embedding_cache, "stage", lambda df, name: seen.append(df.columns) or stage(df, name))
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    found = [embedding_cache.cached_embedding(rows, str(tmp_path / "c"), f"2024-01-01 0{h}:00:00") for h in (0, 1)]
    assert [(f.distinct, f.embedded) for f in found] == [(2, 2), (2, 0)]
    assert not any("_text" in columns for columns in seen)
