import corpus_pipeline


def test_stages_one_after_another(spark):
    sf = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*source.columns, "tokens"]
    rows = out.collect()
    assert 0 < len(rows) < source.count() and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) and len(r["tokens"]) for r in rows)


def test_language_stage_keeps_clean_documents(spark, make_docs):
    docs = make_docs([(1, "The rest of it."), (2, None), (3, "12 34"), (4, "")])
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_language_stage_keeps_columns_of_any_name(spark, make_docs):
    docs = make_docs([(1, "The rest of it."), (2, "12 34")], extra=("score", "lang_pred", "_score"))
    row, = corpus_pipeline.language_stage(spark, docs, "").collect()
    assert (row["doc_id"], row["score"], row["lang_pred"], row["_score"]) == (1, "x", "x", "x")


def test_language_stage_without_languages_keeps_all(spark, make_docs):
    docs = make_docs([(1, "The rest of it."), (2, None), (3, "12 34")], lang=None)
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == [1, 2, 3]
    assert corpus_pipeline.language_stage(spark, docs.limit(0), "").count() == 0
