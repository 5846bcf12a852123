import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultloom.llm.leakage import ItemBlock, leaked_spans, run_lengths, search, sparse_suffix_array, without_leaks, words

DOCS = "doc_id long, text string, item_id string, n_words string"
ITEMS = "item_id long, text string, doc_id string"


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(a, depth):
    a = np.array([*a, 0], np.int64)
    sa = sparse_suffix_array(a, depth)
    want = sorted((i for i in range(len(a)) if i + depth <= len(a) and (a[i : i + depth] != 0).all()), key=lambda i: (a[i : i + depth].tolist(), i))
    assert sa.tolist() == want
    if want:
        q = np.unique(np.array([a[i : i + depth] for i in want] + [[9] * depth]), axis=0)
        lo, hi = search(a, sa, q)
        assert [h - l for l, h in zip(lo, hi)] == [sum(1 for i in want if a[i : i + depth].tolist() == r.tolist()) for r in q]
    assert run_lengths(a).tolist() == [next((k for k in range(len(a) - i) if a[i + k] == 0), 0) for i in range(len(a))]


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 14))), "x") for i in range(12)]
    docs = [(i, ", ".join(rng.choice(vocab + ["zz"]) for _ in range(rng.randrange(0, 60))).upper(), "x", "y") for i in range(60)]
    want = {(d, i, n) for d, t, *_ in docs for i, u, _ in items if (n := longest(words(t), words(u))) >= 4}
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for kw in ({}, {"block_words": 10, "shard_words": 40}):
        got = leaked_spans(df, it, 4, **kw).collect()
        assert {(r.doc_id, r.item_id, r.n_words) for r in got} == want and len(got) == len(want)
    r = got[0]
    d, i = words(dict((x[0], x[1]) for x in docs)[r.doc_id]), words(dict((x[0], x[1]) for x in items)[r.item_id])
    assert d[r.doc_word : r.doc_word + r.n_words] == i[r.item_word : r.item_word + r.n_words]
    clean = {r.doc_id for r in without_leaks(df, it, min_words=4).collect()}
    assert clean == {d[0] for d in docs} - {w[0] for w in want}


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    cjk = "，".join("甲乙丙丁戊己庚辛壬癸子丑寅")
    items = spark.createDataFrame([(1, passage, ""), (2, "too short", ""), (3, None, ""), (4, "", ""), (None, passage, ""), (5, cjk, ""), (1, passage, "")], ITEMS)
    docs = spark.createDataFrame(
        [(1, "x " * 300_000 + passage.replace(" ", "_") + " y", "", ""), (2, passage[: passage.index("p11")], "", ""), (3, None, "", ""), (4, "", "", ""), (5, "P3-P4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14", "", ""), (6, cjk.replace("，", "\n"), "", ""), (7, passage, "", ""), (7, passage, "", "")], DOCS
    )
    got = sorted((r.doc_id, r.item_id, r.n_words) for r in leaked_spans(docs, items).distinct().collect())
    assert got == [(1, 1, 20), (5, 1, 12), (6, 5, 13), (7, 1, 20)]
    assert leaked_spans(docs, items.where("false")).count() == 0 and leaked_spans(docs.where("false"), items).count() == 0
    b = ItemBlock([(9, passage)], 12)
    assert b.find(np.zeros(1, np.int32), np.zeros(0, np.int64))["doc"].size == 0
