from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from faultloom.operators import gate, history, reconcile, selection, stats

T0 = datetime(2026, 1, 1, 12)
SCHEMA = "id long, analyzed_at timestamp, source string, ecosystem string, rule_id string, matched boolean, fingerprint string, excerpt string, resolution string, resolved_at timestamp, resolution_source string, resolved_commit string, repo_id string, git_commit string, status string"


def row(i, fp="a:1", day=0, **kw):
    base = dict(source="b.log", ecosystem="java", rule_id=fp.split(":")[0], matched=True, excerpt="x", resolution=None, resolved_at=None, resolution_source=None, resolved_commit=None, repo_id="r", git_commit="c1", status="open")
    base.update(kw)
    return (i, T0 + timedelta(days=day), base["source"], base["ecosystem"], base["rule_id"], base["matched"], fp, base["excerpt"], base["resolution"], base["resolved_at"], base["resolution_source"], base["resolved_commit"], base["repo_id"], base["git_commit"], base["status"])


@pytest.fixture(scope="module")
def h(spark):
    rows = [
        row(1, resolved_at=T0 + timedelta(hours=6), status="resolved", resolution="done", source="r.xml::N.C.m(1)"),
        row(2, day=1, source="r.xml::N.C.m(2)", repo_id=None),
        row(3, "b:2", day=1, ecosystem=" ", matched=False, rule_id="unknown", excerpt="100%_Done"),
        row(4, "b:2", day=3, ecosystem="Java", resolved_at=T0, status=None, source="r.xml:: "),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_stats(h):
    assert stats.totals(h).first().asDict() == {"total": 4, "open": 3, "resolved": 1, "unmatched": 1}
    assert [tuple(r) for r in stats.by_ecosystem(h).collect()] == [("java", 2), ("Java", 1), ("unknown", 1)]
    s = {r.fingerprint: r for r in stats.fingerprint_stats(h).collect()}
    assert s["a:1"].flaky and s["a:1"].open_count == 1 and s["b:2"].rule_id == "b" and s["b:2"].flaky
    assert stats.recurrence_rate(h).first().recurrence_rate == 1.0
    assert stats.recurrence_rate(h.where("false")).first().recurrence_rate == 0.0
    r = stats.time_to_resolve(h).first()
    assert (r.mean_us, r.n) == (6 * 3600 * 1_000_000, 1)
    days = stats.daily_counts(h, date(2026, 1, 4), 4).collect()
    assert [r.n for r in days] == [1, 2, 0, 1]
    assert stats.daily_counts(h, date(2026, 1, 4), 0).count() == 0
    t = stats.test_stats(h).collect()
    assert {r.test for r in t} == {"N.C.m(1)", "N.C.m(2)"}
    assert stats.test_totals(h).first().failures == 2


def test_filters_and_pages(h):
    assert [r.id for r in history.filtered(h, search="%_dO").collect()] == [3]
    assert history.filtered(h, search=" ").count() == 4
    assert [r.id for r in history.filtered(h, ecosystem="JAVA", since="2026-01-02 12:00:00").orderBy("id").collect()] == [2, 4]
    assert [r.id for r in history.page(h, 2, 1).collect()] == [3, 2]
    assert history.page_count(0) == 1 and history.page_count(101) == 3
    assert [r.id for r in history.prune_survivors(h, "2026-01-02 12:00:00", True).orderBy("id").collect()] == [2, 3, 4]
    assert {r.id: r.status for r in history.backfill_status(h).collect()}[4] == "open"
    assert {r.id: r.event for r in history.new_or_recurring(h).collect()} == {1: "new-failure", 2: "recurrence", 3: "new-failure", 4: "recurrence"}


def test_durations():
    now = datetime(2026, 1, 10, tzinfo=timezone.utc)
    assert history.parse_since("2d", now) == now - timedelta(days=2)
    assert history.parse_since("2026-01-01", now).tzinfo
    assert history.parse_duration("1.5w") == timedelta(days=10.5)
    for bad in ("x", "3", "-1d"):
        with pytest.raises(ValueError):
            history.parse_since(bad, now)
    with pytest.raises(ValueError):
        history.parse_duration("0d")


def test_resolutions(spark, h):
    ev = spark.createDataFrame([(2, 1, "auto", "n1", T0, "h1"), (2, 2, "auto", "n2", T0, "h2"), (3, 1, "auto", "n", T0, "h"), (3, 2, "manual", "m1", T0, None), (3, 3, "manual", "m2", T0, None), (1, 1, "auto", "late", T0, "h")], "id long, seq int, kind string, note string, at timestamp, commit string")
    got = {r.id: (r.resolution, r.resolution_source, r.resolved_commit, r.status) for r in history.fold_resolutions(h, ev).collect()}
    assert got[1] == ("done", None, None, "resolved")  # not open any more
    assert got[2] == ("n1", "auto", "h1", "resolved")
    assert got[3] == ("m2", "manual", "h", "resolved")  # a manual one keeps the stale commit
    new = spark.createDataFrame([(5, "s5"), (4, "s4")], "seq int, source string")
    assert [(r.id, r.source, r.status) for r in history.next_ids(h, new).orderBy("id").collect()] == [(5, "s4", "open"), (6, "s5", "open")]


def test_gate(spark):
    base = gate.baseline_tokens(spark.createDataFrame([("a:1 # x",), ("# no",), (" b:2\r",), ("",), (None,), ("a:1",)], "line string"))
    assert {r.fingerprint for r in base.collect()} == {"a:1", "b:2"}
    seen = spark.createDataFrame([("c:3", "s2", "c", "t2", 2), ("c:3", "s1", "c0", "t1", 1), ("c:3", "s2", "c", "t3", 3), ("a:1", "s", "a", None, 4)], "fingerprint string, source string, rule_id string, title string, seq long")
    new, known, stale = gate.gate(seen, base)
    assert [(r.source, r.title) for r in new.orderBy("seq").collect()] == [("s1", "t1"), ("s2", "t1")]
    r = gate.listed(new).first()
    assert (r.sources, r.rule_id, r.title) == (["s1", "s2"], "c0", "t1")
    assert [r.fingerprint for r in known.collect()] == ["a:1"] and [r.fingerprint for r in stale.collect()] == ["b:2"]
    assert gate.render_baseline(new.unionByName(known)) == ["a:1  # a", "c:3  # t1"]


def test_selection(spark, h):
    f = spark.createDataFrame(
        [(1, "m(1)", "N.C", None, None, "N.C.m(1)"), (2, "m", None, None, None, "m"), (3, "z", "N.C", "z", None, "N.C.z"), (4, "y", "Q", None, "Whole", "Q.y"), (5, "two", None, None, None, "two"), (6, "m(9)", "N.C", None, None, "N.C.m(9)")],
        "seq long, name string, classname string, method string, assembly string, full_name string",
    )
    sk = spark.createDataFrame([("N.C.m", "P1"), ("A.two", "P2"), ("B.two", "P3"), ("B.z", "P3")], "test string, project string")
    pr = spark.createDataFrame([("W", "whole"), ("U", None)], "project string, assembly string")
    m = selection.misses(f, sk, pr)
    got = {r.seq: (r.how, r.test, r.project, r.n_candidates) for r in m.collect()}
    assert got == {1: ("exact", "N.C.m", "P1", 1), 2: ("suffix", "N.C.m", "P1", 1), 4: ("project", "Q.y", "W", 1), 5: ("ambiguous", None, None, 2), 6: ("exact", "N.C.m", "P1", 1)}
    assert sorted(r.seq for r in selection.first_reports(m, f).collect()) == [1, 4, 5]
    hist = selection.with_history(m.where("seq in (1, 4)"), f, h, repo="r").collect()
    assert [(r.seq, r.failures) for r in hist] == [(4, 0), (1, 2)]
    assert {r.project for r in selection.unchecked_projects(f, m, pr).collect()} == {"W", "U"}


def test_commit_graph(spark, h):
    c = spark.createDataFrame([("r", "c1", []), ("r", "c2", ["c1"]), ("r", "c3", ["c1"]), ("r", "c4", ["c2", "c3"]), ("r", "c4", ["c2", "c3"]), ("q", "d1", None)], "repo_id string, sha string, parents array<string>")
    heads = reconcile.heads(c)
    assert {(r.repo_id, r["head"]) for r in heads.collect()} == {("r", "c4"), ("q", "d1")}
    pairs = spark.createDataFrame([("r", "c2", "c4")], "repo_id string, old string, new string")
    assert {r.sha for r in reconcile.commits_between(c, pairs).collect()} == {"c4", "c3"}
    seen = spark.createDataFrame([("b:2",)], "fingerprint string")
    fixed = reconcile.likely_fixed(h, c, heads, seen).collect()
    assert [(r.id, r["head"]) for r in fixed] == []  # row 2 has no repository
    fixed = reconcile.likely_fixed(h.withColumn("repo_id", F.lit("r")), c, heads, seen).collect()
    assert [(r.id, r["head"]) for r in fixed] == [(2, "c4")]
    n = spark.range(1).select(reconcile.note(F.lit("0123456789"), F.array(*[F.lit(x) for x in "abcde"])).alias("n")).first().n
    assert n.startswith("Likely fixed by 0123456 ") and n.endswith("  - c\n  …and 2 more commit(s).")
