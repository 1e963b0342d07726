from itertools import combinations

import numpy as np
import pytest

from fleetlark.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def plain_kernel(s, t):
    """Sum over all pairs of equal subsequences, as the definition has it."""
    def spans(word):
        found = {}
        for at in combinations(range(len(word)), tx.LENGTH):
            key = "".join(word[k] for k in at)
            found[key] = found.get(key, 0.0) + tx.DECAY ** (at[-1] - at[0] + 1)
        return found
    a, b = spans(s), spans(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


WORDS = ["idiot", "idi.ot", "banana", "ananas", "aa", "a", "aaaa", "été", "x" * 9, "moron", "mo_ron"]


def test_kernel_against_its_definition():
    want = np.array([[plain_kernel(s, t) for t in WORDS] for s in WORDS])
    assert np.allclose(tx.subsequence_kernel(WORDS, WORDS), want, rtol=1e-4, atol=1e-6)
    assert np.allclose(tx.self_kernel(WORDS), np.diag(want), rtol=1e-4, atol=1e-6)
    got = tx.similarities(WORDS, WORDS, tx.self_kernel(WORDS))
    own = np.maximum(np.diag(want), 1e-30)
    assert np.allclose(got, (want / np.sqrt(np.outer(own, own))) ** tx.POWER, atol=1e-4)
    assert got[0, 1] > 5 * got[0, 2] and (np.linalg.eigvalsh(got.astype(float)) > -1e-4).all()


@pytest.fixture(scope="module")
def model(spark):
    return tx.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_a_document_at_a_time(spark, sf, model, small_docs):
    """Batches, remembered words and sums give what each text gives by itself, word by word."""
    got = {r["doc_id"]: r["score"] for r in tx.score(small_docs, model).collect()}
    own = tx.self_kernel(model.landmarks)
    for r in small_docs.orderBy("doc_id").limit(40).collect():
        margins = [model.bias + sum(float(tx.similarities([u], model.landmarks, own)[0] @ model.beta) for w in s for u in tx.units(w)) for s in tx.sentences(r["text"] or "")] or [model.bias]
        top, size = min(max([*margins, -1.5]), 0.0), np.log1p(sum(m for m in margins if m > 0))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-(np.array([top, size, 1.0]) @ model.curve)))) < 1e-3


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = tx.op13_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    # documents of quality 0 lost their words to noise after they were labelled, insults too
    toxic = [r for r in rows if r["toxic"] == 1 and r["quality"] == 1]
    assert len(toxic) > 50 and sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)


def test_altered_insults(model):
    """Inserted characters and letters set apart keep a sentence on the side of the insult."""
    margin = lambda text: float(tx.Shares(model.landmarks, model.beta).of(tx.sentences(text)[0]).sum() + model.bias)
    for word in ("idiot", "pathetic", "disgusting", "worthless", "moron"):
        half = len(word) // 2
        for other in (word, word.upper(), word[:half] + "." + word[half:], word[:half] + "x" + word[half:], " ".join(word), "-".join(word), f"({word}!)"):
            assert margin(f"the one {other} of them") > 0, other
    assert margin("the one thing of them") < 0


def test_odd_rows(make_docs, spark, model):
    pairs = [(1, None), (2, ""), (3, "..."), (4, "idiot"), (4, "idiot"), (None, "moron"), (5, "q" * 200_000), (6, "you idiot " * 30_000), (7, "\n\n!? \n"), (8, "\x02 \x03 \0")]
    got = sorted(((r["doc_id"], r["score"]) for r in tx.score(make_docs(pairs, extra=("toxic", "score", "found")), model).collect()), key=str)
    assert len(got) == 10 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1] == by[2] == by[3] == by[7] and by[6] > by[4] > by[1]
    assert tx.score(make_docs([]), model).count() == 0 and [r["score"] for r in tx.score(make_docs(pairs), 1.0).collect()] == [1.0] * 10


def test_fits_without_two_classes(make_docs, spark):
    docs = make_docs([(1, "good words here"), (2, None), (3, "x")])
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
    assert tx.fit(docs, labels()) == 0.0 and tx.fit(docs, labels((1, 0, 1), (2, 0, None), (None, 0, 0))) == 1.0
    assert tx.fit(docs, labels((1, 0, 1), (9, 0, 0))) == 0.5
    for model in (tx.fit(docs, labels((1, 0, 1), (2, 0, 0))), tx.fit(docs, labels((2, 0, 1), (3, 0, 0))), tx.fit(docs, labels((1, 0, 1), (1, 0, 0), (1, 0, 0)))):
        assert all(0 <= r["score"] <= 1 for r in tx.score(docs, model).collect())


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, signs, costs = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.random(60) + 0.1

    def primal(w):
        return 0.5 * w @ w + (costs * np.maximum(0, 1 - signs * (x @ w[:-1] + w[-1]))).sum()
    best = np.append(*tx.support_vector_machine(x, signs, costs, epochs=500))
    assert all(primal(best) <= primal(best + rng.normal(size=6) * s) + 1e-3 for s in (0.01, 0.1) for _ in range(200))


def test_words_and_sentences():
    assert tx.sentences("One two. Three\nfour i d i o t very!  x\n\n") == [["one", "two."], ["three"], ["four", "idiot", "very!"], ["x"]]
    assert tx.units("(i.d.i.o.t!)") == tx.units("i d i o t") == tx.units("idiot!") == tx.units("idiot") == ["\x02idiot\x03"] and tx.units("***") == []
    assert "".join(u[:16] for u in tx.units("a" * 100)).count("a") >= 95 and max(map(len, tx.units("b" * 1000))) == 32
    assert [len(s) for s in tx.sentences("ww " * 100)] == [48, 48, 4]


def test_plain_words_are_not_searched_for_signs(monkeypatch):
    """Every word was matched against the pattern of spelt-out ones, and every word of a line looked at for single characters."""
    from fleetlark.llm import toxicity as tx

    class Pattern:
        asked = []

        def fullmatch(self, word, pattern=tx._SPELT):
            self.asked.append(word)
            return pattern.fullmatch(word)

    monkeypatch.setattr(tx, "_SPELT", Pattern())
    assert [tx.units(w) for w in ("plain,", "i.d.i.o.t", "ünï", "a_b_c", "x", "?!")] == [["\x02plain\x03"], ["\x02idiot\x03"], ["\x02ünï\x03"], ["\x02abc\x03"], ["\x02x\x03"], []]
    assert Pattern.asked == ["i.d.i.o.t", "a_b_c"]
    assert tx.joined(["i", "d", "i", "o", "t", "no", "a", "b"]) == ["idiot", "no", "a", "b"] and tx.joined(["a", "no", "b"]) == ["a", "no", "b"]
    shares = tx.Shares(["\x02word\x03"], tx.np.ones(1))
    assert shares.of(["word", "other", "word"]).tolist() == shares.of(["word", "other", "word"]).tolist() and list(shares.number.values()) == [0, 1]
