import random
from datetime import datetime, timedelta

from faultloom.operators.gap_scan import reappearances

DAY = 86_400


def brute(rows, silence):
    out = set()
    for kind, pos in (("fp", 2), ("rule", 3)):
        last = {}
        for r in sorted((r for r in rows if r[pos] is not None and r[1] is not None), key=lambda r: (r[1], r[0])):
            if r[pos] in last and (r[1] - last[r[pos]]).total_seconds() > silence:
                out.add((kind, r[pos], r[0]))
            last[r[pos]] = r[1]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, at timestamp, fp string, rule string, part string, edge int, kind string")


def run(df, silence, parts):
    return sorted(tuple(r) for r in reappearances(df, {"fp": "fp", "rule": "rule"}, "at", "id", silence, parts).collect())


def test_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    t0 = datetime(2026, 1, 1)
    rows = [(i, t0 + timedelta(seconds=rng.randrange(200 * DAY)), "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}", rng.choice(["r1", "r2", None]), "p", 1, "k") for i in range(1500)]
    for parts in (1, 5, 23):
        assert run(frame(spark, rows), DAY, parts) == sorted(brute(rows, DAY))


def test_edges(spark):
    t0 = datetime(2026, 1, 1)
    exact = [(1, t0, "a", None, "", 0, ""), (2, t0 + timedelta(days=21), "a", None, "", 0, ""), (3, t0 + timedelta(days=42, microseconds=1), "a", None, "", 0, ""), (3, t0 + timedelta(days=42, microseconds=1), "a", None, "", 0, ""), (4, None, "a", None, "", 0, ""), (None, t0, "a", None, "", 0, "")]
    assert run(frame(spark, exact), 21 * DAY, 4) == [("fp", "a", 3)]
    assert run(frame(spark, []), DAY, 3) == []
