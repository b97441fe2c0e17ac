import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_small_table(spark, tmp_path):
    base = [" ".join(f"word{chr(97 + k)}{i}" for i in range(40)) for k in range(4)]
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = [
        (1, base[0], "en"), (2, base[0], "en"), (3, base[1] + " " + passage, "en"), (4, passage + " " + base[2], "de"),
        (5, None, None), (6, "12 34", "en"), (7, base[3] + " x" * 3, "en"), (8, base[3] + " x" * 4, None), (9, "solo", "en"),
    ]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    docs, seen = df, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == df.columns
    assert [sorted(s) for s in seen[:3]] == [[1, 2, 3, 4, 7, 8, 9], [2, 3, 4, 7, 8, 9], [2, 3, 4, 7, 9]]
    assert seen[3][4].text == base[2] and seen[3][3].text == rows[2][1] and seen[3][4].n_chars == len(base[2])
    assert sorted(seen[4]) == sorted(seen[3])
    assert sorted(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen[4])
