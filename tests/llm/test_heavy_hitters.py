from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultloom.llm.heavy_hitters import frequent_items, merge, misra_gries, shrink


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 8))
def test_bound_holds_for_any_split(parts, k):
    summary, true = {}, Counter()
    for p in parts:
        own: dict = {}
        for x in p:
            own = merge(own, [x], [1], k)
        true.update(p)
        summary = merge(summary, list(own), list(own.values()), k)
    n = sum(true.values())
    assert len(summary) <= k
    for x, c in true.items():
        assert c - n / (k + 1) <= summary.get(x, 0) <= c


def test_shrink_subtracts_the_next_largest():
    assert shrink({"a": 5, "b": 3, "c": 2}, 2) == {"a": 3, "b": 1}
    assert shrink({"a": 1, "b": 1}, 1) == {}


def test_frequent_items_exactly(spark):
    rows = [("hot",)] * 400 + [("warm",)] * 100 + [(f"x{i}",) for i in range(490)] + [(None,)] * 10
    df = spark.createDataFrame(rows, "item string").repartition(7)
    got = {r["item"]: r.n_rows for r in frequent_items(df, "item", 0.1).collect()}
    assert got == {"hot": 400, "warm": 100}  # exactly at the threshold counts; nulls are rows but no item
    s = misra_gries(df, "item", 3).collect()
    assert sum(r.rows for r in s) == 1000 and len([r for r in s if r["item"]]) <= 3
    loose = frequent_items(df, "item", 0.1, exact=False).collect()
    assert {"hot", "warm"} <= {r["item"] for r in loose}


def test_edges(spark):
    empty = spark.createDataFrame([], "item string, count int, rows int")
    assert frequent_items(empty, "item", 0.01).collect() == []
    nulls = spark.createDataFrame([(None, 1, 2)] * 5, "item string, count int, rows int")
    assert frequent_items(nulls, "item", 0.01).collect() == []
    clash = spark.createDataFrame([(7, "a", "b")] * 3, "total long, count string, item string")
    assert [(r["item"], r.n_rows) for r in frequent_items(clash, "total", 0.5).collect()] == [(7, 3)]


def test_every_split_is_folded_by_its_own_task(spark):
    df = spark.range(0, 40_000, 1, 10).select((F.col("id") % 7).alias("item"))
    s = misra_gries(df, "item", 20, fan_in=3)
    assert {r["item"]: r["count"] for r in s.collect() if r["item"] is not None} == Counter(i % 7 for i in range(40_000))
    plan = s._jdf.queryExecution().toString()
    assert "Coalesce" not in plan and plan.count("MapInArrow") >= 3


def test_hot_value_of_a_third_of_the_rows(spark):
    df = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("item"))
    assert [(r["item"], r.n_rows) for r in frequent_items(df, "item", 0.01).collect()] == [("hot", 10_000)]
