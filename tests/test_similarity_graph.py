import random

import pytest
from pyspark.sql import functions as F

from faultloom.operators import similarity as V
from faultloom.operators.components import min_label_components


def brute_components(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)], []])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1)], "u long, v long")
    assert {r.vertex: r.component for r in min_label_components(df).collect()} == brute_components(edges)


def test_cosine_pairs_and_clusters(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, {w: rng.randint(1, 3) for w in rng.sample(words, 6)}) for i in range(40)] + [(100, {"w1": 1, "zz": 2}), (101, {"w1": 1, "zz": 2}), (102, {})]
    df = spark.createDataFrame(docs, "id long, terms map<string,int>")
    rows = V.term_rows(df, "id", F.col("terms"))
    n = sum(1 for _, t in docs if t)
    idf = {r.term: r["idf"] for r in V.idf(rows, F.lit(n)).collect()}

    def cos(a, b):
        d = lambda x, y: sum(x[t] * y[t] * idf[t] ** 2 for t in x if t in y)
        return d(a, b) / (d(a, a) * d(b, b)) ** 0.5 if a and b else 0

    for t in (0.3, 0.5, 0.9):
        want = {(a, b) for i, (a, x) in enumerate(docs) for b, y in docs[i + 1 :] if cos(x, y) >= t}
        assert {(r.a, r.b) for r in V.cosine_pairs(rows, t).collect()} == want
    meta = df.select("id", F.lit("r").alias("rule_id"), (F.col("id") > 100).alias("matched"), F.lit(" ").alias("ecosystem"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("analyzed_at"))
    members = V.cluster_members(meta, rows, 0.95)
    c = {r.cluster: r for r in V.cluster_summary(members).collect()}
    assert {r.id for r in members.where("cluster = 100").collect()} == {100, 101} and c[100].label == "r" and c[100].ecosystems == ["unknown"] and c[0].label == "unmatched" and 102 in c
    assert [r.cluster for r in V.top_clusters(V.cluster_summary(members), 1).collect()] == [min(c, key=lambda k: (-c[k].n, k))]


def test_tops(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (2, {"a": 1}), (3, {"a": 1}), (4, {"b": 1}), (5, {})], "id long, terms map<string,int>")
    got = [(r.query_id, r.id, r["rank"]) for r in V.tfidf_top(df.where("id in (1, 4)"), df, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 3, 1), (1, 2, 2)]  # equal scores: the newer first
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<float>")
    got = [(r.id, r["rank"]) for r in V.vector_top(v.where("id = 1"), v, 5).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]
    assert V.vector_top(v.where("id = 9"), v).count() == 0


def test_local_contraction_keeps_components():
    import numpy as np

    from faultloom.operators.components import contracted

    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        u, v = rng.integers(0, 150, n), rng.integers(0, 150, n)
        u, v = np.append(u, np.arange(1000, 1200)), np.append(v, np.arange(1001, 1201))  # a chain besides
        parent = {int(x): int(x) for x in np.append(u, v)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        a, b = contracted(u, v)
        assert dict(zip(a.tolist(), b.tolist())) == {x: find(x) for x in parent if find(x) != x}
