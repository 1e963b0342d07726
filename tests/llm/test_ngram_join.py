import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from fleetlark.llm import ngram_join as nj

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def word_sets(rows, width=3):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()))
    return out


def brute(rows, percent=90):
    sets, root = word_sets(rows), {}
    for i, _ in sets:
        root[i] = i
    find = lambda x: x if root[x] == x else find(root[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and None not in (a, b) and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((a, len(x), find(a)) for a, x in sets)


def run(docs, **how):
    return sorted(map(tuple, nj.ngram_jaccard_join(docs, **how).collect()))


def family(rng, n, words=60, changes=2):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(words)] = f"v{rng.randrange(99)}"
        yield " ".join(copy)


def test_the_table(spark, small_docs):
    assert run(small_docs) == brute([(r["doc_id"], r["text"]) for r in small_docs.collect()])


@pytest.mark.parametrize("block", [nj.BLOCK_SHINGLES, 400])
def test_families(make_docs, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", block)
    rng = random.Random(block)
    texts = [t for size in (2, 3, 30, 60) for t in family(rng, size)]
    chain = [f"c{i}" for i in range(50)]
    texts += [" ".join(chain[:20 + i]) for i in range(30)]  # each is like the next, the ends are not
    texts += ["the same passage that many share here " + t for t in family(rng, 20, 12, 6)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(make_docs(rows)) == brute(rows)


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, BLANK), (4, "One"), (5, "oNE\n"), (6, "one two"), (7, "two one"), (8, "É"), (9, "é"), (10, "a b c"), (11, "A\x0bB\x0cC"),
            (12, "x" * 300_000), (13, "x" * 300_000), (14, "y z " * 50_000), (15, "y z " * 50_001)]
    assert run(make_docs(rows, extra=("key", "component", "rep"))) == brute(rows)
    assert run(make_docs(rows).limit(0)) == []
    assert (None, 1, None) in [tuple(r) for r in nj.ngram_jaccard_join(make_docs([(None, "a b c"), (1, "a b c")])).collect()]
    twice = run(make_docs([(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d")]))
    assert twice == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_one_of_each_stays(make_docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (9, None), (4, "other words here"), (None, "a b c d")]
    assert {r["doc_id"] for r in nj.keep_one_of_each(make_docs(rows)).collect()} == {3, 4, 9, None}


def test_short_documents_keep_the_order_of_words(make_docs):
    from itertools import permutations
    rows = list(enumerate(" ".join(p) for words in ("a", "ab", "abc", "abcd") for p in permutations(words)))
    docs = make_docs(rows + [(100 + i, text.upper()) for i, text in rows])
    assert {r["doc_id"] for r in nj.keep_one_of_each(docs, threshold="0.8", width=5).collect()} == {i for i, _ in rows}


def test_t_occurrence_against_counting():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 25))]
        least = rng.randrange(1, len(lists) + 2)
        counts = {v: sum(v in x for x in lists) for v in range(40)}
        assert sorted(nj.t_occurrence(lists, least)) == [(v, c) for v, c in counts.items() if c >= least]


def test_block_links_connect_what_brute_force_connects():
    import numpy as np
    rng = random.Random(2)
    for t in ("0.5", "0.8", "0.9"):
        base = rng.sample(range(1000), 40)
        sets = [np.array(sorted(set(rng.sample(base, rng.randrange(30, 41)) + rng.sample(range(1000), 2))), np.uint64) for _ in range(60)]
        links = nj.block_links(list(range(60)), sets, Fraction(t))
        assert len(links) < 60
        for a, b in links:
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert len(x & y) >= float(t) * len(x | y) - 1e-12
        root = list(range(60))
        for a, b in links:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        for a in range(60):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if Fraction(len(x & y), len(x | y)) >= Fraction(t):
                    assert root[a] == root[b]


@pytest.mark.parametrize("families,members", [(2, 3), (3, 4), (7, 2), (5, 40)])
def test_block_links_of_families_of_like_size(families, members):
    sets = [np.array([*range(f * 1000, f * 1000 + 100), f * 1000 + 500 + k], np.uint64) for f in range(families) for k in range(members)]
    links = nj.block_links(list(range(len(sets))), sets, Fraction("0.9"))
    assert len(links) == families * (members - 1)
    assert all(a // members == b // members for a, b in links)


@pytest.mark.parametrize("t", ["0.3", "0.5", "0.8", "0.9", "0.95"])
def test_linked_sets_share_a_kept_key(t):
    """The rule of keys, for frequencies of any order and both shares of keys."""
    t, rng = Fraction(t), random.Random(5)
    for _ in range(3000):
        n = rng.randint(1, 40)
        a = set(rng.sample(range(1000), n))
        b = set(rng.sample(sorted(a), n - rng.randint(0, min(n - 1, 1 + n // 4)))) | set(rng.sample(range(1000, 2000), rng.randint(0, 1 + n // 8)))
        if len(a & b) < t * len(a | b):
            continue
        df = {x: rng.random() for x in a | b}
        for share in (nj.FIRST_KEYS * (1 / t - 1), max(nj.MORE_KEYS, 2 * (1 / t - 1))):
            place = {x: rng.random() for x in a | b}
            kept = [set(sorted(sorted(x, key=place.get)[:nj._ceil(min(Fraction(1), share) * len(x))], key=df.get)[:math.floor(len(x) / t) - len(x) + 1])
                    for x in (a, b)]
            assert kept[0] & kept[1]


def test_keys_are_moved_once(make_docs):
    """Keys were moved twice, to be counted and to find their counts."""
    from fractions import Fraction

    from fleetlark.llm import ngram_join as nj

    docs = make_docs([(k, " ".join(f"w{(k % 3) * 5 + i}" for i in range(40))) for k in range(9)])
    signed = nj.checkpoint(nj._signatures(docs, 3, Fraction(1, 2)))
    plan = nj._shared_keys(signed, Fraction("0.8"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1
