from datetime import datetime, timezone

import pytest

from faultloom.operators.log_entries import EntryParser, log_entries

NOW = int(datetime(2026, 3, 2, 12, 0, tzinfo=timezone.utc).timestamp() * 1000)


def ms(*a):
    return int(datetime(*a[:6], tzinfo=timezone.utc).timestamp() * 1000) + (a[6] if len(a) > 6 else 0)


@pytest.mark.parametrize(
    "line, want",
    [
        ("2026-01-08T23:14:16.360Z INFO  [fetch-proxy] hello", (ms(2026, 1, 8, 23, 14, 16, 360), "INFO", "fetch-proxy", "hello")),
        ("2026-01-08T23:14:16.9999+02:00 a.b WARN level=x", (ms(2026, 1, 8, 21, 14, 16, 999), "WARN", "a.b", "level=x")),
        ("1768128571740|ERROR|buildd|a|b", (1768128571740, "ERROR", "buildd", "a|b")),
        ("[2026-01-14 14:57:49] [warning] pool.worker: it: ok", (ms(2026, 1, 14, 14, 57, 49), "WARN", "pool.worker", "it: ok")),
        ("03-01 08:19:29.911 24765  4767 V proxy: x", (ms(2026, 3, 1, 8, 19, 29, 911), "TRACE", "proxy", "x")),
        ("12-31 08:19:29.911 24765  4767 F proxy: x", (ms(2025, 12, 31, 8, 19, 29, 911), "FATAL", "proxy", "x")),
        ("E0229 01:02:03.456789  19870 queue.cc:364] y", (ms(2024, 2, 29, 1, 2, 3, 456), "ERROR", "queue", "y")),
        ("[11:59:59] a_b: crit: z", (ms(2026, 3, 2, 11, 59, 59), "FATAL", "a_b", "z")),
        ("[12:00:01] a_b: notice: z", (ms(2026, 3, 1, 12, 0, 1), "INFO", "a_b", "z")),
        ('{"level": "warn", "msg": "a \\"b\\"\\n", "time": "2026-02-03 20:45:59.397", "component": "c", "n": 1}', (ms(2026, 2, 3, 20, 45, 59, 397), "WARN", "c", 'a "b"')),
        ('{"timestamp":"2026-02-03T20:45:59Z","severity":"VERBOSE","logger":"c","message":"m"}', (ms(2026, 2, 3, 20, 45, 59), "TRACE", "c", "m")),
        ("2026-02-21 13:27:04,415 - cache_task - INFO - m - n", (ms(2026, 2, 21, 13, 27, 4, 415), "INFO", "cache_task", "m - n")),
        ("Mar  1 08:10:27 host sync.core[22892]: <debug> m", (ms(2026, 3, 1, 8, 10, 27), "DEBUG", "sync.core", "m")),
        ("Mar  1 08:10:27 host sync.core[22892]: error: m", (ms(2026, 3, 1, 8, 10, 27), "", "sync.core", "error: m")),
        ("[Mon Jan 05 11:44:02.123456 2026] [fetchd:err] [pid 26026] m", (ms(2026, 1, 5, 11, 44, 2, 123), "ERROR", "fetchd", "m")),
        ("2026-02-19T04:37:48Z critical: m", (ms(2026, 2, 19, 4, 37, 48), "FATAL", "", "m")),
        ('lvl=err time=2026-01-12T09:38:50.694Z msg="a \\"q\\" C:\\\\x" logger=c run=1', (ms(2026, 1, 12, 9, 38, 50, 694), "ERROR", "c", 'a "q" C:\\x')),
        ('ts=2026-01-12T09:38:50Z level=info component=c msg="m"', (ms(2026, 1, 12, 9, 38, 50), "INFO", "c", "m")),
    ],
)
def test_layouts(line, want):
    rows = EntryParser().entries(line, NOW)
    assert [r[1:5] for r in rows] == [want] and rows[0][0] == 1 and rows[0][5] == 1


@pytest.mark.parametrize("line", ["", "{", '{"a": 1}', "  2026-01-08T23:14:16.360Z INFO  [x] y", "2026-99-08T23:14:16Z INFO [x] y", "-- level=warn was kept --", "last good run 2026-01-01T00:00:00Z", "level=info no time", "2026-01-08T23:14:16Z a.b NOTALEVEL m"])
def test_what_is_no_header(line):
    assert EntryParser().entries(line, NOW) == []


def test_continuations_and_leading_lines():
    t = "tail of before\r\n\x1b[32m2026-01-08T23:14:16Z INFO\x1b[0m [a] one\r\n\r\n  at x\r\n2026-01-08T23:14:17Z WARN  [b] two  \r\n{\n}\n"
    rows = EntryParser().entries(t, NOW)
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in rows] == [(1, "INFO", "a", "one", 3), (2, "WARN", "b", "two", 3)]


def test_frame_edges(spark):
    at = datetime(2026, 3, 2, 12, 0)
    schema = "id long, analyzed_at timestamp, excerpt string, level string, message int"
    long = "2026-01-08T23:14:16Z INFO [a] x\n" + "y\n" * 200_000
    rows = [(1, at, None, "x", 1), (2, at, "", "x", 1), (3, at, "no header", "x", 1), (4, None, "2026-01-08T23:14:16Z INFO [a] x", "x", 1), (None, at, "2026-01-08T23:14:16Z INFO [a] x", "x", 1), (5, at, long, "x", 1), (5, at, long, "x", 1)]
    got = log_entries(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.id or 0, r.n_lines) for r in got) == [(0, 1), (4, 1), (5, 200_001), (5, 200_001)]
    assert log_entries(spark.createDataFrame([], schema)).collect() == []


def test_without_a_bound_only_incomplete_times_are_null(spark):
    text = "2024-01-02T03:04:05Z ERROR [a.b] boom\n02-29 08:19:29.911 24765  4767 V proxy: x\n[11:59:59] a_b: crit: z\n02-30 08:19:29.911 24765  4767 V proxy: no day"
    df = spark.createDataFrame([(1, None, text)], "id long, analyzed_at timestamp, excerpt string")
    got = [(r.entry_no, r.ts_ms, r.level, r.n_lines) for r in log_entries(df).collect()]
    assert got == [(1, ms(2024, 1, 2, 3, 4, 5), "ERROR", 1), (2, None, "TRACE", 1), (3, None, "FATAL", 2)]
