import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.operators import cosine_join as J
from faultloom.operators import similarity as V


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    k = rng.integers(0, 90, 300)
    row = np.repeat(np.arange(300), k)
    term = np.concatenate([np.sort(rng.choice(2**31 - 1 if i % 2 else 400, n, replace=False)) for i, n in enumerate(k)])
    tf = rng.choice([1, 1, 1, 2, 127, 128, 2**31 - 1, 0, -3], len(row))
    for cut in (0, 57):  # also of a slice
        v = J.pack(300, row, term, tf).slice(cut)
        got = J.unpack(v)
        assert all((x == y[row >= cut]).all() for x, y in zip(got, (row - cut, term, tf)))
    assert sum(len(x) for x in J.unpack(J.pack(0, row[:0], term[:0], tf[:0]))) == 0


@pytest.mark.parametrize("frequent, at_once", [(1 << 18, 8192), (7, 8192), (1 << 18, 11), (0, 11)])
def test_pairs_are_complete_and_single(spark, monkeypatch, frequent, at_once):
    monkeypatch.setattr(V, "FREQUENT", frequent)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, {w: rng.choice([1, 1, 1, 2, 5]) for w in rng.choices(words, weights=range(1, 61), k=9)} | ({f"s{i}": 1} if i % 3 else {})) for i in range(150)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)] + [(2000, None), (2001, {}), (None, {"w1": 1})]
    df = spark.createDataFrame(docs, "id long, terms map<string,int>")
    n, count = sum(1 for i, t in docs if t and i is not None), {}
    for _, t in docs:
        for w in t or ():
            count[w] = count.get(w, 0) + 1
    vec = {i: {w: f * (np.log((1 + n) / (1 + count[w])) + 1) for w, f in t.items()} for i, t in docs if t and i is not None}
    norm = {i: sum(x * x for x in t.values()) ** 0.5 for i, t in vec.items()}
    want = {(a, b): c for a in vec for b in vec if a < b and (c := sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / norm[a] / norm[b]) >= 0.5}
    join = J.compare

    def small(idf, threshold):
        run = join(idf, threshold)

        def tiles(batches):
            before, J.ROWS_AT_ONCE = J.ROWS_AT_ONCE, at_once
            try:
                yield from run(batches)
            finally:  # the worker is used again
                J.ROWS_AT_ONCE = before

        return tiles

    monkeypatch.setattr(J, "compare", small)
    for rows in (V.term_bags(df, "id", F.col("terms")), V.term_rows(df, "id", F.col("terms"))):
        got = V.cosine_pairs(rows, 0.5).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.cosine for r in got} == pytest.approx(want)


def test_terms_of_a_repeated_id_are_put_together(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 1}), (1, {"a": 1, "c": 1}), (2, {"a": 2, "b": 1, "c": 1}), (3, {"d": 1})], "id long, terms map<string,int>")
    got = V.cosine_pairs(V.term_bags(df, "id", F.col("terms")), 0.5).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_what_is_shuffled_follows_the_rows(spark):
    """Neither candidates nor pairs are shuffled: below the result there is one exchange, of the index."""
    df = spark.createDataFrame([(i, {"x": 1, "y": 1, f"z{i % 5}": 1}) for i in range(200)], "id long, terms map<string,int>")
    plan = V.cosine_pairs(V.term_bags(df, "id", F.col("terms")), 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") <= 2 and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_copies_follow_the_first_of_them(spark, monkeypatch, frequent):
    """A row with further terms of its own is no copy; terms in another order are."""
    monkeypatch.setattr(V, "FREQUENT", frequent)
    docs = [(9, {"a": 1, "b": 2}), (4, {"b": 2, "a": 1}), (6, {"a": 1, "b": 1}), (7, {"c": 1, "d": 3}), (8, {"c": 1, "d": 3, "own": 90}), (5, {"c": 1, "d": 3, "mine": 90}), (1, {"alone": 1}), (2, {"else": 1}), (3, {})]
    df = spark.createDataFrame(docs, "id long, terms map<string,int>")
    got = V.cluster_members(df.select("id"), V.term_bags(df, "id", F.col("terms")), 0.8)
    assert {r.id: r.cluster for r in got.collect()} == {9: 4, 4: 4, 6: 4, 7: 7, 8: 8, 5: 5, 1: 1, 2: 2, 3: 3}


def test_rows_are_packed_where_they_are_read(spark):
    """No bag of terms is joined, grouped or sorted on the way to the vectors that clusters compare."""
    df = spark.createDataFrame([(i, {"x": 1, f"y{i % 7}": 2, f"own{i}": 1}) for i in range(50)], "id long, terms map<string,int>")
    vectors, _ = V.packed_vectors(V.term_bags(df, "id", F.col("terms")), V.Scratch(spark))
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert vectors.count() == 50 and not any(x in plan for x in ("Join", "Aggregate", "Sort"))
