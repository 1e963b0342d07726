from fleetlark.llm import language
from fleetlark.llm.lattice import Vocabulary, read_model, units


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_scores_against_one_text_at_a_time(spark, small_docs):
    import numpy as np

    from fleetlark.llm.lattice import Lattice
    langs, logp = language.fit(small_docs, 50)
    vocabulary = Vocabulary(read_model())
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    for r in language.predict(small_docs, langs, logp).limit(20).collect():
        total = np.zeros(len(langs))
        for unit in units(texts[r["doc_id"]]):
            lattice = Lattice.of([unit], vocabulary)
            total += lattice.totals(lattice.forward(lattice.weights(logp, vocabulary)))[0]
        assert r["lang_pred"] == langs[int(total.argmax())]
        assert abs(r["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_odd_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "123 ... 😀"), (4, "the and of"), (4, "the and of"), (None, "the")], extra=("score", "lang_pred"))
    out = language.identify(docs).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert all(r["score"] == 0 for r in out if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language.identify(make_docs([(1, "no language known")], lang=None)).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_copies_neither_fill_the_sample_nor_weigh_more(spark, make_docs, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    texts = [f"text number {i} with words of its own w{i}" for i in range(400)]
    docs = make_docs(list(enumerate(texts)))
    # The copied text is one that the sample of 100 takes, as its hash is the smallest.
    hot = docs.orderBy(F.pmod(F.xxhash64("text"), F.lit(1_000_000))).first()["text"]
    copied = make_docs(list(enumerate(texts + [hot] * 2000)))
    langs, logp = language.fit(docs, 100)
    for rows, sample in ((copied, 100), (make_docs(list(enumerate(texts + texts[:9] * 50))), 100)):
        again, other = language.fit(rows, sample)
        assert again == langs and np.allclose(other, logp, rtol=0, atol=1e-9)
    assert np.allclose(language.fit(copied)[1], language.fit(docs)[1], rtol=0, atol=1e-9)
