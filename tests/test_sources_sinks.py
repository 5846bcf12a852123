import gzip
import json

import pytest
from pyspark.sql import functions as F

from faultloom.operators.rules import Rule, match_rules
from faultloom.sinks import outputs
from faultloom.sources import reports, stores

JUNIT = """<?xml version="1.0"?><testsuites xmlns="urn:x"><testsuite name="C:\\out\\App.Tests.dll"><testcase name="ok" classname="A"/>
<testcase name="f" classname="N.C"><failure message="m&#10;n"> body </failure><error>e</error></testcase><testcase><error> only text </error></testcase></testsuite></testsuites>"""
TRX = """<TestRun xmlns="urn:t"><TestDefinitions><UnitTest id="A1" storage="/o/x.dll"><TestMethod className="N.C, App, V=1" name="m"/></UnitTest><UnitTest id="a1"><TestMethod className="Z" name="z"/></UnitTest></TestDefinitions>
<Results><UnitTestResult testId="a1" testName="N.C.m(1)" outcome="TimeOut"><Output><ErrorInfo><Message> late </Message><StackTrace>at x</StackTrace></ErrorInfo></Output></UnitTestResult><UnitTestResult testName="q" outcome="NotExecuted"/></Results>
<ResultSummary><RunInfos><RunInfo outcome="Error"><Text> host died </Text></RunInfo></RunInfos></ResultSummary></TestRun>"""


def test_formats():
    assert reports.parse_format("") == "auto" and reports.parse_format("dotnet") == "trx" and reports.parse_format("?") is None
    assert reports.detect_format("a.TRX", "") == "trx" and reports.detect_format("a.xml", JUNIT) == "junit" and reports.detect_format("a", TRX) == "trx"
    assert reports.detect_format("a", "<broken") == "log" and reports.detect_format(None, "text") == "log"


def test_failures(spark):
    files = spark.createDataFrame([("a.xml", JUNIT), ("b.trx", TRX), ("c.log", "boom"), ("d.xml", "<testsuite"), ("e", None), ("f", "")], "source string, content string")
    got = [tuple(r) for r in reports.test_failures(files).orderBy("source", "seq").collect()]
    assert got[0] == ("a.xml", "f", "N.C", "m\nn", "body", None, "App.Tests", "N.C.f", 0)
    assert got[1][1:5] == ("(unknown)", None, "only text", "only text")
    assert got[2] == ("b.trx", "m(1)", "N.C", "late", "at x", "m", "x", "N.C.m(1)", 0)
    assert got[3][1:4] == ("Test run aborted", None, "host died") and len(got) == 4
    u = {r.source: r.text for r in reports.units(files).collect()}
    assert u["a.xml::N.C.f"] == "FAILED: N.C.f\nm\nn\nbody\n" and u["c.log"] == "boom" and u["d.xml"] == "<testsuite"
    with pytest.raises(Exception, match="no element|unclosed|ParseError"):
        reports.test_failures(files.where("source = 'd.xml'"), forced="junit").collect()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_text("one\ntwo")
    (tmp_path / "sub" / "b.TXT").write_text("x")
    (tmp_path / "c.bin").write_text("no")
    with gzip.open(tmp_path / "d.log.gz", "wt") as f:
        f.write("packed")
    got = {r.source.rsplit("/", 1)[1]: r.content for r in reports.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.log": "one\ntwo", "b.TXT": "x", "d.log.gz": "packed"}
    with pytest.raises(ValueError):
        reports.read_files(spark, "/x*/a.log")


def test_selection_report(spark):
    ok = {"schemaVersion": 1, "skippedTests": [{"project": "P", "tests": ["a", "b"]}, {"project": "Q", "tests": ["a", ""]}], "skippedProjects": [{"project": "W", "assembly": ""}]}
    t, p = reports.read_selection(spark, json.dumps(ok))
    assert sorted(map(tuple, t.collect())) == [("a", "P"), ("b", "P")] and [tuple(r) for r in p.collect()] == [("W", None)]
    for bad in ({}, {"schemaVersion": 2}, {"schemaVersion": 1}):
        with pytest.raises(ValueError):
            reports.read_selection(spark, json.dumps(bad))


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "s")], "id long, source string").withColumn("analyzed_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    stores.append_history(df, str(tmp_path / "h"))
    assert stores.open_history(spark, str(tmp_path / "h")).select("id", "source", "status").first() == (1, "s", None)
    with pytest.raises(KeyError, match="known"):
        stores.opener("nosuch")


def test_documents(spark):
    logs = spark.createDataFrame([("a::b", "Java", "boom 7"), ("c", "Go", "fine")], "source string, ecosystem string, text string")
    rows = match_rules(logs, [Rule("r-x", r"boom (?<n>\d)", title="T", fix="F {n}", confidence=0.66665)]).select(outputs.analysis_json().alias("j")).collect()
    a, b = (json.loads(r.j) for r in rows)
    assert a["rootCause"]["confidence"] == 0.6666 and a["rootCause"]["captures"] == {"n": "7"} and "docs" not in a["rootCause"]
    assert b == {"source": "c", "ecosystem": "go", "matched": False, "matches": []}
    q = spark.createDataFrame([("a\\b::t", "f:1", "r-x", "T", "F\nG", 0.7, None, 3), ("", "u:1", None, None, None, None, None, None)], "source string, fingerprint string, rule_id string, title string, fix string, score double, severity string, line_number int")
    x, y = (json.loads(r.issue) for r in outputs.code_quality(q).collect())
    assert x == {"description": "T — F", "checkName": "r-x", "fingerprint": "f:1", "severity": "minor", "location": {"path": "a/b", "lines": {"begin": 3}}}
    assert y["location"]["path"] == "stdin" and y["severity"] == "info"
    s = json.loads(outputs.sarif([r.asDict() for r in q.collect()]))
    assert [r["level"] for r in s["runs"][0]["results"]] == ["warning", "note"] and len(s["runs"][0]["tool"]["driver"]["rules"]) == 2
    p = outputs.prometheus({"total": 2, "open": 1, "resolved": 1, "unmatched": 0}, [('a"b', 2)], [("f:1", "r", 2)], 0.5, 0, 1.5)
    assert 'build_failures_by_ecosystem{ecosystem="a\\"b"} 2' in p and "build_recurrence_rate 0.5\n" in p
    assert outputs.number(3.0) == "3" and outputs.sparkline([0, 2]) == "0,24 100,0"
    assert "1 of 2" in outputs.markdown([r.asDict() for r in q.collect()])
    assert json.loads(outputs.rows_json(q.limit(1)).first().json)["line_number"] == 3
