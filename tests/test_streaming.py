from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultloom.session import Scratch
from faultloom.streaming import events


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40), st.integers(1, 30), st.one_of(st.none(), st.integers(0, 50)))
def test_sent_times(at, window, last):
    at = np.array(sorted(at), np.int64)
    want, l = [], last
    for i, t in enumerate(at):
        if l is None or t - l >= window:
            want.append(i)
            l = int(t)
    got, end = events.sent_times(at, last, window)
    assert got.tolist() == want and end == l


def test_budget():
    t = [0.0]
    b = events.Budget(per_run=4, per_minute=2, clock=lambda: t[0])
    assert [b.take(), b.take(), b.take()] == [True, True, False]
    t[0] = 60
    assert [b.take(), b.take(), b.take()] == [True, True, False]
    t[0] = 200
    assert not b.take()


def test_streams_over_several_batches(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    schema = "event string, fingerprint string, at timestamp, id long, analyzed_at timestamp"
    for no, ids in enumerate(([1, 2, 4], [3, 5, 6])):
        spark.createDataFrame([("e", f"f{i % 2}", t0 + timedelta(seconds=100 * i), i, t0 + timedelta(days=i)) for i in ids], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(no)))
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sent = {r.id for r in events.run_to_table(events.deduplicated(src(), 300), Scratch(spark)).collect()}
    assert sent == {1, 2, 5, 6}  # 3 and 4 lie within the window of 1 and 2; 5 and 6 do not
    assert sum(r.n for r in events.daily_counts(src(), Scratch(spark)).collect()) == 6
    got = {r.id: r.event for r in events.recurrence(src(), Scratch(spark)).collect()}
    assert got == {1: "new-failure", 2: "new-failure", 3: "recurrence", 4: "recurrence", 5: "recurrence", 6: "recurrence"}
    assert events.only_events(spark.createDataFrame([("new-failure",), ("resolved",)], "event string"), {"newfailure"}).count() == 1
