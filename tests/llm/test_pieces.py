import math
from collections import Counter

import numpy as np
import pytest

from fleetlark.llm import lattice as lt
from fleetlark.llm import pieces

TEXTS = ["", " ", "the", "a  b\nc\t", "▁x ▁", "ünïcödé 😀 漢字 ʘ\u0000", "x" * 3000, "don't_stop, 3.14 - yes!", "  two  spaces  "]


@pytest.fixture(scope="module")
def vocabulary():
    return lt.Vocabulary(lt.read_model())


def ways(word, vocabulary):
    """All segmentations of a unit with their log-probabilities."""
    if not word:
        yield (), 0.0
    for n in range(1, len(word) + 1):
        ids = [k for k in (vocabulary.surface.get(word[:n]),) if k is not None]
        if not ids and n == 1:
            ids = lt.spelt(vocabulary, ord(word[0])).tolist()
        if ids:
            for rest, p in ways(word[n:], vocabulary):
                yield (*ids, *rest), p + sum(vocabulary.prior[k] for k in ids)


@pytest.fixture(scope="module")
def brute(vocabulary):
    special = set(vocabulary.byte_ids.tolist())
    vocabulary.surface = {x.decode(): k for k, x in enumerate(vocabulary.bytes) if x and k not in special}
    return lambda word: dict(ways(word, vocabulary))


def test_decoding_is_lossless(vocabulary):
    ids = pieces.Sampler(vocabulary).sample(TEXTS, np.arange(len(TEXTS), dtype=np.uint64))
    assert [vocabulary.decode(x.tolist()) for x in ids] == TEXTS


def test_draws_do_not_depend_on_what_was_met_before(vocabulary, monkeypatch):
    keys = np.arange(len(TEXTS), dtype=np.uint64)
    one_by_one = [pieces.Sampler(vocabulary).sample([t], keys[k:k + 1])[0].tolist() for k, t in enumerate(TEXTS)]
    monkeypatch.setattr(pieces, "_KEPT_BYTES", 1000)
    monkeypatch.setattr(pieces, "_SLICE_CHARS", 7)  # runs end within texts
    sampler = pieces.Sampler(vocabulary)
    assert [x.tolist() for x in sampler.sample(TEXTS, keys)] == one_by_one
    assert [sampler.sample([t], keys[k:k + 1])[0].tolist() for k, t in enumerate(TEXTS)] == one_by_one


def test_sums_and_draws_follow_all_segmentations(vocabulary, brute):
    for word in (" thing", "zq漢", " b"):
        all_ways = brute(word)
        grid = lt.Lattice.of([word], vocabulary)
        weights = grid.weights(vocabulary.prior, vocabulary)
        total = math.log(sum(math.exp(p) for p in all_ways.values()))
        assert abs(grid.totals(grid.forward(weights))[0] - total) < 1e-9
        assert abs(grid.backward(weights)[0] - total) < 1e-9
    n = 4000
    drawn = Counter(tuple(x.tolist()) for x in pieces.Sampler(vocabulary, 0.5).sample(["thing"] * n, np.arange(n, dtype=np.uint64)))
    share = {w: math.exp(0.5 * p) for w, p in brute(" thing").items()}
    whole = sum(share.values())
    assert sum(abs(drawn[w] / n - p / whole) for w, p in share.items()) < 0.15


def test_rows(spark, make_docs):
    docs = make_docs([*enumerate(TEXTS), (99, None), (None, "the"), (2, "the")], extra=("_key",))
    out = pieces.decode(pieces.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out) and len(out) == len(TEXTS) + 3
    assert [r["tokens"] for r in out if r["doc_id"] == 2][0] == [r["tokens"] for r in out if r["doc_id"] == 2][1]
    again = pieces.encode(docs.repartition(7)).select("doc_id", "tokens").collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tokens"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    other = pieces.encode(docs, seed=1).collect()
    assert sorted(map(key, other)) != sorted(map(key, out))
    assert pieces.encode(docs.limit(0)).count() == 0


def test_long_text_is_lossless_in_bounded_memory(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "_KEPT_BYTES", 4 << 20)
    text = " ".join(f"word{k} {k * 7919}, naïve" for k in range(50_000))[:1_000_000]
    sampler = pieces.Sampler(vocabulary)
    ids = sampler.sample([text, "the"], np.arange(2, dtype=np.uint64))
    assert len(text) == 1_000_000 and vocabulary.decode(ids[0].tolist()) == text
    # what one run adds to the kept lattices stays below this
    assert sampler.nbytes < (4 << 20) + 200 * pieces._SLICE_CHARS


def test_decoded_in_the_same_pass(spark, make_docs):
    docs = make_docs([*enumerate(TEXTS), (99, None), (None, "the")], extra=("_key", "decoded"))
    both = pieces.encode(docs, decoded="decoded")
    assert both.columns == [*[c for c in docs.columns if c != "decoded"], "tokens", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in both.collect())
    apart = pieces.decode(pieces.encode(docs.drop("decoded"))).select("doc_id", "tokens", "decoded")
    assert sorted(map(str, both.select("doc_id", "tokens", "decoded").collect())) == sorted(map(str, apart.collect()))
