import random

import pytest

from fleetlark.llm import lines as ll


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def brute(rows, threshold=0.8):
    """Dropped line numbers by (doc_id, text), all pairs of lines compared."""
    rows = sorted({(i, text or "") for i, text in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    places = sorted((((i is not None, i or 0), no, line.strip(), i, text) for i, text in rows for no, line in enumerate((text or "").split("\n")) if line.strip()),
                    key=lambda p: p[:2])
    lines = list(dict.fromkeys(p[2] for p in places))
    sets, root = [shingles(x) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= threshold * large and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    of, seen, out = dict(zip(lines, root, strict=True)), set(), {r: [] for r in rows}
    for _, no, line, i, text in places:
        if of[line] in seen:
            out[i, text].append(no)
        seen.add(of[line])
    return out


def run(docs, **how):
    hashed = {r["h"]: r["text"] or "" for r in docs.selectExpr("xxhash64(coalesce(text, '')) AS h", "text").collect()}
    return {(r["doc_id"], hashed[r["text_hash"]]): list(r["dropped"]) for r in ll.line_decisions(docs, **how).collect()}


def test_the_table(spark, small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    found, want = run(small_docs), brute(rows)
    differing = sum(len(set(found[k]) ^ set(want[k])) for k in want)
    assert differing <= 0.01 * sum(map(len, want.values()))


@pytest.mark.parametrize("block", [ll.BLOCK_SHINGLES, 900])
def test_odd_rows(make_docs, monkeypatch, block):
    monkeypatch.setattr(ll, "BLOCK_SHINGLES", block)
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(40))
    near = [long.replace(" ", f" {k}", 1) for k in range(12)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "ab\nab\n\nab "), (5, "ab"), (6, long), (7, "intro line of its own\n" + long + "!"), (8, "x" * 60_000), (9, "x" * 60_000 + "y"),
            (10, "😀é"), (11, "😀é"), (12, "\n".join(near)), (6, long), (None, "ab\nzz\nyy"), *[(20 + k, x) for k, x in enumerate(near)]]
    docs = make_docs(rows, extra=("line", "key", "dropped"))
    assert run(docs) == brute(rows)
    assert run(docs.limit(0)) == {}


def test_texts_without_their_lines(make_docs):
    rows = [(1, "a line that comes twice\nfirst"), (2, "a line that comes twice\nsecond"), (3, "a line that comes twice"), (4, ""), (5, None)]
    docs = make_docs(rows, extra=("dropped",))
    out = ll.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None) == [(1, rows[0][1], 29), (2, "second", 6), (4, "", 0)]
    assert out.where("text IS NULL").count() == 1
    assert ll.dedup_lines(docs, drop_emptied=False).where("doc_id = 3").first()["text"] == ""


def test_columns_may_have_any_names(make_docs):
    names = ("_text", "_touched", "_gone", "_lines", "_changed", "row", "content", "changed", "touched", "text_hash", "dropped", "n_lines", "f", "d")
    rows = [(1, "a line that comes twice\nfirst"), (2, "a line that comes twice\nsecond"), (None, "a line that comes twice\nthird")]
    docs = make_docs(rows, extra=names)
    out = ll.dedup_lines(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    found = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"], {r[n] for n in names}) for r in out.collect()), key=lambda r: r[0])
    assert found == [(0, "a line that comes twice\nthird", 29, {"x"}), (1, "first", 5, {"x"}), (2, "second", 6, {"x"})]


def test_small_blocks_are_compared_together(monkeypatch):
    """Each block of two lines was a call of its own, of more than a millisecond."""
    rng = random.Random(7)
    blocks = []
    for k in range(300):
        line = " ".join(str(rng.randrange(10**4)) for _ in range(rng.choice([1, 2, 12])))
        blocks.append([line, *(line[:(c := rng.randrange(len(line)))] + rng.choice("xyz") * rng.randrange(1, 3) + line[c:] for _ in range(k % 8))])
    names = {x: 3 * i for i, x in enumerate(dict.fromkeys(x for b in blocks for x in b))}
    rows = [x for b in blocks for x in dict.fromkeys(b)]
    starts = ll.np.cumsum([0] + [len(dict.fromkeys(b)) for b in blocks])
    calls = []
    monkeypatch.setattr(ll, "block_links", lambda ids, sets, t, search=ll.block_links: calls.append(len(ids)) or search(ids, sets, t))
    found = ll.links_of_blocks(ll.np.array([names[x] for x in rows]), rows, starts, ll.Fraction("0.8"))
    assert calls and min(calls) > ll.SMALL_BLOCK
    alike = lambda x, y: 5 * len(shingles(x) & shingles(y)) >= 4 * len(shingles(x) | shingles(y))
    want = {frozenset((names[x], names[y])) for b in blocks if len(set(b)) <= ll.SMALL_BLOCK for x in b for y in b if x != y and alike(x, y)}
    found = {frozenset(pair) for pair in zip(*(x.tolist() for x in found), strict=True)}
    of = {i: x for x, i in names.items()}
    assert 20 < len(want) and want <= found and all(alike(*(of[i] for i in pair)) for pair in found)


def test_blocks_are_not_cut_where_batches_end():
    blocks = [1, 1, 1, 2, 3, 3, 3, 3, 3, 5]
    for size in (1, 2, 3, 20):
        batches = [ll.pa.RecordBatch.from_arrays([ll.pa.array(blocks[a:a + size])], ["block"]) for a in range(0, len(blocks), size)]
        tables = [t["block"].to_pylist() for t in ll._whole_blocks(iter(batches))]
        assert [x for t in tables for x in t] == blocks
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
