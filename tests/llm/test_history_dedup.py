import random
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import history_dedup
from faultloom.llm.history_dedup import AcceptedHistory, Records, refused_by_batches, refused_records, Segment, Segments

T0 = datetime(2026, 1, 1, 23, 50)
OLD = "analyzed_at timestamp, fingerprint string, terms array<string>, ord string, at string, block string"
NEW = "record_id long, batch_no int, analyzed_at timestamp, fingerprint string, terms array<string>, ord string, h string, batch string"


def alike(a, b):
    a, b = set(a or ()), set(b or ())
    return bool(a | b) and len(a & b) * 10 >= 7 * len(a | b)


def brute(old, new):
    acc = [r for r in old if r[0] is not None]
    out = set()
    seen = set()
    for i, b, at, fp, t in sorted((r for r in new if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[0])):
        if i in seen or at is None:
            continue
        seen.add(i)
        if any((fp is not None and fp == f and at.replace(microsecond=0) == a.replace(microsecond=0)) or (abs(at - a) <= timedelta(minutes=15) and alike(t, s)) for a, f, s in acc):
            out.add(i)
        else:
            acc.append((at, fp, t))
    return out


def run(spark, old, new, **kw):
    a = spark.createDataFrame([(*r, "x", "y", "z") for r in old], OLD)
    b = spark.createDataFrame([(*r, "x", "y", "z") for r in new], NEW)
    got = [r.record_id for r in refused_records(a, b, F.col("terms"), F.col("terms"), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, shard", [(1, 40_000), (2, 7)])
def test_matches_brute_force(spark, seed, shard):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    bases = [rng.sample(vocab, rng.choice([1, 2, 4, 10, 25, 40])) for _ in range(12)]

    def terms():
        t = set(rng.choice(bases))
        for _ in range(rng.randrange(8)):
            t ^= {rng.choice(vocab)}
        return sorted(t)

    when = lambda: T0 + timedelta(seconds=rng.randrange(4000), microseconds=rng.choice([0, 1, 999_999]))
    old = [(when(), f"f{rng.randrange(300)}", terms()) for _ in range(40)]
    new = [(i, rng.randrange(1, 8), when(), f"f{rng.randrange(300)}", terms()) for i in range(120)]
    want = brute(old, new)
    assert 5 < len(want) < 120 and run(spark, old, new, shard_rows=shard) == want


def test_order_decides(spark):
    """A refused record refuses nobody; the next one stands alone again."""
    m = timedelta(minutes=1)
    t = ["a", "b", "c"]
    new = [(1, 1, T0, "x", t), (2, 1, T0 + 10 * m, "x", t), (3, 1, T0 + 20 * m, "x", t), (4, 2, T0 + 5 * m, "x", t), (5, 3, T0 + 35 * m, "x", t), (6, 3, T0 + 35 * m + timedelta(microseconds=1), "x", t)]
    assert run(spark, [], new) == brute([], new) == {2, 4, 5}


def test_edges(spark):
    t = ["a", "b", "c"]
    old = [(T0, "f", t), (None, "f", t), (T0, None, None)]
    new = [
        (1, 1, T0 + timedelta(milliseconds=900), "f", None), (2, 1, T0 + timedelta(seconds=1), "f", []), (3, 1, T0 - timedelta(minutes=15), "g", t), (4, 1, T0 - timedelta(minutes=15, microseconds=1), "g2", t),
        (5, 1, None, "f", t), (6, None, T0, "f", t), (None, 1, T0, "f", t), (7, 1, T0, None, None), (8, 1, T0, None, ["q"]), (9, 2, T0, None, ["q"]), (9, 2, T0, None, ["q"]),
    ]
    # 4 is too early for the history and close to 3, but 3 is refused and so refuses nobody
    assert run(spark, old, new) == brute(old, new) == {1, 3, 9}
    assert run(spark, [], []) == set() and run(spark, old, []) == set()


def test_many_equal_records_at_one_instant(spark):
    new = [(i, i % 3, T0, f"f{i}", ["hot", "text"]) for i in range(300)] + [(1000 + i, 1, T0, "same", [f"u{i}"]) for i in range(100)]
    assert run(spark, [], new) == brute([], new)


def recs(sets, at):
    sets = [np.unique(np.array(s, np.int64)) for s in sets]
    return Records(np.arange(len(sets)), np.array(at, np.int64), np.append(0, np.cumsum([len(s) for s in sets])), np.concatenate(sets))


def test_segments_find_every_pair_and_stay_few():
    rng = random.Random(9)
    sets = [rng.sample(range(60), rng.choice([1, 2, 3, 8, 21, 22, 30])) for _ in range(64)]
    sets += [sorted(set(s) ^ set(rng.sample(range(60), min(3, len(s) // 6)))) for s in sets]
    at = [rng.randrange(1000) for _ in sets]
    all_ = recs(sets, at)
    held = Segments()
    for k in range(0, 128, 8):
        held.add(all_.take(np.arange(k, k + 8)))
    assert len(held.held) == 1  # sixteen batches, merged like a binary counter
    held.add(all_.take(np.arange(0, 8)))
    assert len(held.held) == 2
    want = {(i, j) for i in range(128) for j in range(128) if abs(at[i] - at[j]) <= 100 and alike(sets[i], sets[j])}
    for s in (Segment(all_), Segment.merge(Segment(all_.take(np.arange(60))), Segment(all_.take(np.arange(60, 128))))):
        i, j = s.probe(all_, 100, Fraction(7, 10))
        assert set(zip(i.tolist(), s.rec.order[j].tolist())) == want


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], likeness=Fraction(1, 2))


def test_batches_one_by_one_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history_dedup, "SLICE", 50)
    rng = random.Random(8)
    bases = [rng.sample(range(90), n) for n in (1, 3, 12, 30)]
    terms = lambda: sorted({f"w{x}" for x in set(rng.choice(bases)) ^ set(rng.sample(range(90), rng.randrange(4)))})
    when = lambda: T0 + timedelta(seconds=rng.randrange(5000))
    old = [(when(), f"f{rng.randrange(200)}", terms()) for _ in range(25)]
    new = [(i, i // 15, when(), f"f{rng.randrange(200)}", terms()) for i in range(60)]
    held = AcceptedHistory(spark, str(tmp_path / "h"), shard_rows=9)
    held.accept(spark.createDataFrame([(*r, "x", "y", "z") for r in old], OLD), F.col("terms"))
    got = set()
    for b in range(4):
        batch = spark.createDataFrame([(*r, "x", "y", "z") for r in new if r[1] == b], NEW)
        got |= {r.record_id for r in held.offer(batch, F.col("terms")).collect()}
    assert got == brute(old, new) and len(held.live) == 2  # the history and four batches merged


@pytest.mark.parametrize("part_rows", [1_000_000, 9])
def test_chains_and_copies_over_many_parts(spark, monkeypatch, part_rows):
    """Copies every ten minutes in order of time: every other one is refused, however they are cut."""
    monkeypatch.setattr(history_dedup, "PART_ROWS", part_rows)
    rng = random.Random(6)
    chain = [(i, 1, T0 + timedelta(minutes=10 * i), f"f{i}", ["hot", "copy"]) for i in range(40)]
    other = [(100 + i, rng.randrange(1, 4), T0 + timedelta(minutes=rng.randrange(400)), f"g{rng.randrange(9)}", rng.choice([["hot", "copy", "x"], ["a", "b", "c", "d"], ["a", "b", "c"], None])) for i in range(40)]
    assert run(spark, [], chain) == brute([], chain) == set(range(1, 40, 2))
    assert run(spark, [], chain + other) == brute([], chain + other)


@pytest.mark.parametrize("hours", [20, 60])
def test_windows_of_more_than_half_a_block(spark, tmp_path, hours):
    noon = datetime(2026, 1, 5, 12)
    terms = lambda n: [f"t{n}-{x}" for x in range(30)]
    old = [(noon + timedelta(hours=1), "f", terms(0)), (noon - timedelta(hours=hours), "f", terms(1)), (noon - timedelta(hours=hours, seconds=1), "f", terms(2))]
    new = [(i, 1, noon, f"g{i}", terms(i)) for i in range(3)] + [(3, 1, noon, "h3", terms(9)), (4, 2, noon + timedelta(hours=2), "h4", terms(9))]
    assert run(spark, old, new, window_seconds=hours * 3600) == {0, 1, 4}
    held = AcceptedHistory(spark, str(tmp_path / "h"), window_seconds=hours * 3600)
    held.accept(spark.createDataFrame([(*r, "x", "y", "z") for r in old], OLD), F.col("terms"))
    batch = spark.createDataFrame([(*r, "x", "y", "z") for r in new[:3]], NEW)
    assert {r.record_id for r in held.offer(batch, F.col("terms")).collect()} == {0, 1}


def test_one_crowded_day_copies_a_record_a_bounded_number_of_times(spark):
    """Ten times as many rows in one window make more shards, not more copies of a record."""
    from faultloom.llm.history_dedup import _placed
    from faultloom.llm.neardup import term_hashes
    from faultloom.session import Scratch

    rng = random.Random(2)
    copies = {}
    for n in (300, 3000):
        rows = [(i, 0, i % 1000, [f"w{rng.randrange(10 * n)}" for _ in range(20)]) for i in range(n)]
        x = spark.createDataFrame(rows, "ord long, batch long, at long, t array<string>").select("ord", "batch", "at", term_hashes(F.col("t")).alias("h"))
        index, probes = _placed(x, x, 900_000_000, Fraction(7, 10), 30, Scratch(spark))
        most = index.groupBy("block", "sub", "shard").count().agg(F.max("count")).first()[0]
        copies[n] = index.count() / n
        assert copies[n] <= 7 and most <= 30 * 7 * 3
    assert copies[3000] < 1.5 * copies[300]


def test_stored_state_is_resumed(spark, tmp_path):
    t = lambda n: [f"t{n}-{x}" for x in range(9)]
    path = str(tmp_path / "h")
    one = AcceptedHistory(spark, path)
    one.accept(spark.createDataFrame([(T0, "f", t(0), "x", "y", "z")], OLD), F.col("terms"))
    batch = lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], NEW)
    assert {r.record_id for r in one.offer(batch([(1, 1, T0, "g", t(0)), (2, 1, T0, "h", t(1))]), F.col("terms")).collect()} == {1}
    one._write(spark.createDataFrame([], "ord long, at long, h array<long>, fp string"), 0)  # never committed
    two = AcceptedHistory(spark, path)
    assert {r.record_id for r in two.offer(batch([(3, 2, T0, "i", t(1)), (4, 2, T0, "j", t(2))]), F.col("terms")).collect()} == {3}
    assert len(two.live) == 2  # the history, and two batches merged


def test_query_by_batches_agrees(spark, tmp_path):
    rng = random.Random(18)
    bases = [rng.sample(range(90), n) for n in (3, 12, 30)]
    terms = lambda: sorted({f"w{x}" for x in set(rng.choice(bases)) ^ set(rng.sample(range(90), rng.randrange(4)))})
    when = lambda: T0 + timedelta(seconds=rng.randrange(5000))
    old = [(when(), f"f{rng.randrange(200)}", terms()) for _ in range(25)]
    new = [(i, i // 15, when(), f"f{rng.randrange(200)}", terms()) for i in range(45)] + [(None, 1, T0, "f", terms()), (50, None, T0, "f", terms())]
    got = refused_by_batches(spark.createDataFrame([(*r, "x", "y", "z") for r in old], OLD), spark.createDataFrame([(*r, "x", "y", "z") for r in new], NEW), F.col("terms"), F.col("terms"), str(tmp_path / "b"))
    assert {r.record_id for r in got.collect()} == brute(old, new)
    got = refused_by_batches(spark.createDataFrame([(*r, "x", "y", "z") for r in old], OLD), spark.createDataFrame([(*r, "x", "y", "z") for r in new], NEW), F.col("terms"), F.col("terms"), str(tmp_path / "c"), together=2)
    assert {r.record_id for r in got.collect()} == brute(old, new)
