import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

import oracle_check
from fleetlark.llm import resampling as rs

SF = "/root/testdata/sf0.01"


def brute(docs, target, percent=10, least=20, width=1, buckets=rs.BUCKETS, seed=2024):
    """One text at a time, whole texts, no lines."""
    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return words, [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(words) - k + 1)]
    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([x for _, x in docs], target))
    total, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, len(words) >= least and i is not None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0], r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=str)


def run(docs, target, **options):
    return sorted(map(tuple, rs.importance_resample(docs, target, **options).collect()), key=str)


def bench(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def test_the_table_against_sql(spark):
    assert oracle_check.differences(rs.op11_resampling(spark, SF), oracle_check.connect(SF), rs.OP11_SQL) is None


@pytest.mark.parametrize("width", [1, 2, 3])
def test_the_table_against_brute_force(spark, small_docs, sf, width):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert run(small_docs, target, width=width, percent=37) == brute(docs, [r["text"] for r in target.collect()], width=width, percent=37)


LINES = ["Alpha beta GAMMA", "alpha beta", "", "x", "y z", "été Été alpha", "a-b_c9\tq", "\r", "alpha beta GAMMA"]


@pytest.mark.parametrize("width", [1, 3])
def test_odd_rows(spark, make_docs, width):
    texts = [None, "", "\n\n", *LINES, "\n".join(LINES), "\n".join(reversed(LINES)), "\n".join(["x"] * 50), "word " * 60_000, "q" * 300_000]
    pairs = [*enumerate(texts), (4, "again, the same id " * 5), (4, "again, the same id " * 5), (None, "no id " * 30), (-7, "x\ny\nz z\n\nx")]
    docs = make_docs(pairs, extra=("score", "weight", "rank", "line", "times"))
    target = ["alpha beta gamma", None, "", "x\ny"]
    assert run(docs, bench(spark, target), width=width, least_words=2, percent=50) == brute(pairs, target, width=width, least=2, percent=50)


def test_empty_tables(spark, make_docs):
    docs = make_docs([(1, "one two three"), (2, "two")])
    assert run(docs, bench(spark, []), least_words=1, percent=100) == brute([(1, "one two three"), (2, "two")], [], least=1, percent=100)
    assert run(docs.limit(0), bench(spark, ["x"])) == []
    assert all(r[4] is None for r in run(docs, bench(spark, ["x"])))


def test_ranks_with_many_ties(spark):
    rows = [(i, i % 3, (i * 7919) % 5 - 1030, i % 4 > 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, score long, may boolean")
    for draw in (0, 1, 77, 300, 1000):
        got = {r["doc_id"]: r["rank"] for r in rs.ranked(df, draw).collect()}
        able = sorted((r for r in rows if r[3]), key=lambda r: (-r[2], r[0]))[:draw]
        assert len(got) == 400 and {k: v for k, v in got.items() if v} == {r[0]: k + 1 for k, r in enumerate(able)}


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=5), max_size=5), st.integers(1, 4))
def test_lines_and_seams_make_up_all_runs(lines, width):
    whole = rs.runs([w for line in lines for w in line], width)
    assert Counter(whole) == Counter([g for line in lines for g in rs.runs(line, width)] + rs.seams(lines, width))
