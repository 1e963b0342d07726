import hashlib
import statistics

from fleetlark.llm import fingerprint as fp


def brute(rows):
    """(doc_id, text) to results, by the definition, one at a time."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    parser, out = fp.Parser(), []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        a, b, c = (fp.fingerprint(t, parser) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(a), fp.to_text(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def run(docs):
    return sorted(map(tuple, fp.fingerprint_documents(docs).collect()), key=str)


def test_against_brute_force(spark, small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert run(small_docs) == brute(rows)


def test_many_ranges(spark, small_docs, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_CHARS", 20_000)
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert run(small_docs) == brute(rows)


def test_odd_rows(make_docs):
    rows = [(7, None), (5, ""), (5, "  \n "), (-3, "one two three one two three"), (-3, "one two three one two three"), (None, "last é😀x"), (9, "x" * 200_000)]
    assert run(make_docs(rows, extra=("range", "tail"))) == brute(rows)
    assert run(make_docs([(4, "only one")])) == brute([(4, "only one")])
    assert run(make_docs(rows).limit(0)) == []
    assert run(make_docs([(None, "a b"), (None, "c d")])) == brute([(None, "a b"), (None, "c d")])


def test_likeness_tells_edits_from_neighbours(spark, small_docs):
    rows = fp.fingerprint_documents(small_docs).where("n_chars > 300").collect()
    assert statistics.mean(r["near_edited"] for r in rows) > 0.4 > 0.2 > statistics.mean(r["near_next"] for r in rows)


def test_phrases_by_hand():
    parser, phrases = fp.Parser(), set()
    parser.parse("a b a b a b c".split(), phrases)  # a | b | a b | a b c
    assert len(phrases) == 4
