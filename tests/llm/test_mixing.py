import hashlib

from fleetlark.llm import mixing


def brute(rows, share=mixing.SHARE, epochs=mixing.EPOCHS, weights=mixing.WEIGHTS):
    """(doc_id, lang, source, text) to {doc_id: copies}, for ids that do not repeat."""
    def domain(source):
        tail = (source or "")[3:]
        return ("web", "curated")[int(tail) % 2] if tail.isdigit() else "unknown"
    docs = [(i, (domain(s), lang or "unknown", s or "unknown"), (len((t or "").encode()) + 3) // 4) for i, lang, s, t in rows]
    leaves = {}
    for _, leaf, n in docs:
        leaves[leaf] = leaves.get(leaf, 0) + n
    plan = {}

    def pour(prefix, budget):
        level = len(prefix)
        if level == 3:
            plan[prefix] = budget
            return
        children = {leaf[level] for leaf in leaves if leaf[:level] == prefix}
        cap = {c: sum(n * epochs for leaf, n in leaves.items() if leaf[:level + 1] == (*prefix, c)) for c in children}
        weight = {c: weights[level].get(c, 1) for c in children}
        got, open_ = {}, set(children)
        while full := {c for c in open_ if cap[c] * sum(weight[x] for x in open_) <= budget * weight[c]}:
            for c in full:
                got[c] = cap[c]
                budget -= cap[c]
            open_ -= full
        whole = sum(weight[x] for x in open_)
        got |= {c: budget * weight[c] // whole for c in open_}
        for c in children:
            pour((*prefix, c), got[c])
    total = sum(leaves.values())
    pour((), min(total * share[0] // share[1], total * epochs))
    out = {}
    for leaf, budget in plan.items():
        n = leaves[leaf]
        whole, rest = divmod(budget, n) if n else (0, 0)
        mine = sorted((hashlib.md5(f"0|{whole}|{i}".encode()).hexdigest(), i, m) for i, where, m in docs if where == leaf)
        total, going = 0, True
        for _, i, m in mine:
            total += m
            going = going and total <= rest
            out[i] = whole + going
    return out


def run(docs, **how):
    return {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, **how).collect()}


def test_the_table(spark, small_docs, monkeypatch):
    rows = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in small_docs.collect()]
    assert run(small_docs) == brute(rows)
    monkeypatch.setattr(mixing, "RANGE_DOCS", 3)
    assert run(small_docs, epochs=1) == brute(rows, epochs=1)


def test_odd_rows(spark, make_docs):
    rows = [(1, None, None, None), (2, "en", "src0", ""), (3, "en", "src0", "x" * 100), (4, "xx", "odd", "y" * 4000), (5, "de", "src3", "é" * 10)]
    docs = spark.createDataFrame([(i, t, lang, s, 0, "d") for i, lang, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tokens string")
    assert run(docs) == brute(rows)
    assert run(docs.limit(0)) == {}
    twice = docs.union(docs).unionByName(docs.withColumn("doc_id", docs["doc_id"] * 0 + 9))
    assert mixing.mix_sources(twice).count() == 15


def test_clashing_names_and_both_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(k if k % 5 else None, "word " * (k % 7), "en", f"src{k % 3}", "mine", k) for k in range(60)],
                                 "doc_id long, text string, lang string, source string, last string, epochs int")
    wanted = sorted(mixing.mix_sources(docs).select("epochs", "copies", "last").collect())
    assert len(wanted) == 60 and {r["last"] for r in wanted} == {"mine"}
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(mixing.mix_sources(docs).select("epochs", "copies", "last").collect()) == wanted
