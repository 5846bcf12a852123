import json

from faultloom.operators.rules import Rule
from faultloom.plans.pipeline import analyze, margins, similar_failures
from faultloom.session import Scratch
from faultloom.sinks import outputs
from faultloom.sources.packs import search_path
from faultloom.streaming import events

PACK = [Rule("r-miss", r"package (?<p>\S+) not found", confidence=0.9, title="Missing"), Rule("r-any", "not found", confidence=0.6)]


def test_analyze(spark):
    logs = spark.createDataFrame(
        [(1, "2026-01-01T00:00:00Z a\r\nnpm ERR! x\r\nPackage Left-Pad NOT found 17\r\nend"), (2, "all\nis error 5\nwell"), (3, None), (4, ""), (5, "all\nis error 6\nwell")], "id long, text string"
    )
    got = {r.id: r for r in analyze(logs, PACK).collect()}
    r = got[1]
    assert (r.ecosystem, r.rule_id, r.matched, r.text.split("\n")[0]) == ("node", "r-miss", True, "a")
    assert [m.rule_id for m in r.matches] == ["r-miss", "r-any"] and r.excerpt == "a\nnpm ERR! x\nPackage Left-Pad NOT found 17\nend"
    assert got[2].rule_id == "unknown" and got[2].fingerprint == got[5].fingerprint != r.fingerprint and got[2].log_hash != got[5].log_hash
    assert got[2].tokens == {"all": 1, "is": 1, "error": 1, "well": 1} and got[3].tokens is None and not got[3].matched and got[4].tokens == {}
    m = margins(analyze(logs, PACK)).collect()
    assert [(r.id, round(r.margin, 6)) for r in m] == [(1, 0.3)]
    sim = similar_failures(analyze(logs, PACK).where("id = 2"), analyze(logs, PACK), 1).collect()
    assert [(r.query_id, r.id) for r in sim] == [(2, 5)]


def test_more_outputs(spark):
    q = spark.createDataFrame([("a\\b::t", "f:1", "r-x", "T: 1", "F\nG", 0.7, None, 3), ("", "u:1", None, None, None, None, None, None)], "source string, fingerprint string, rule_id string, title string, fix string, score double, severity string, line_number int")
    assert [r.command for r in outputs.annotations(q).collect()] == ["::warning file=a/b,line=3,title=T%3A 1::F%0AG", "::notice file=stdin,line=1,title=Unknown failure::"]
    assert [r["id"] for r in json.loads(outputs.rules_json(PACK))] == ["r-any", "r-miss"]
    h = spark.sql("SELECT 1L AS id, timestamp'2026-01-01 00:00:00' AS analyzed_at, timestamp'2026-01-01 01:00:00' AS resolved_at, 'resolved' AS status, true AS matched, 'java' AS ecosystem, 'f:1' AS fingerprint, 'f' AS rule_id")
    o = json.loads(outputs.statistics_json(h))
    assert o["total"] == 1 and o["meanTimeToResolutionSeconds"] == 3600 and o["topFailures"][0]["count"] == 1


def test_search_path(tmp_path):
    (tmp_path / "home" / ".build-rules").mkdir(parents=True)
    (tmp_path / "a" / "b" / ".build-rules").mkdir(parents=True)
    (tmp_path / "a" / ".build-rules").mkdir()
    own = tmp_path / "x"
    own.mkdir()
    got = [str(p.relative_to(tmp_path.resolve())) for p in search_path(tmp_path / "home", tmp_path / "a" / "b", [str(own)], [str(own), str(tmp_path / "none")])]
    assert got == ["home/.build-rules", "a/.build-rules", "a/b/.build-rules", "x"]


def test_deliver(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "id long").write.parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    out.mkdir()

    def send(row):
        if row["id"] == 2:
            raise RuntimeError
        (out / str(row["id"])).write_text("x")

    events.deliver(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), send, Scratch(spark))
    assert sorted(p.name for p in out.iterdir()) == ["0", "1", "3", "4"]
    ask = events.limited(lambda t: t.upper(), events.Budget(per_run=1), 3)
    assert (ask("abcdef"), ask("abcdef")) == ("DEF", None)


def test_drafts_that_say_nothing_are_refused():
    from faultloom.operators.assist import too_broad

    for p in ("", ".*", "(.+)", "^.*$", r"[\s\S]*", "(?s).*", "^(.*)$", r"\w*", r"\s", "x?", r"(?<a>.+)"):
        assert too_broad(p), p
    for p in ("error", "failed", "exception", "exit code (?<n>\\d+)"):
        assert not too_broad(p), p


def test_blocks_of_batches():
    from faultloom.streaming.events import blocks_before

    for n in range(70):
        b = blocks_before(n)
        assert [x for a, e in b for x in range(a, e)] == list(range(n)) and len(b) <= 7 and all(a % (e - a) == 0 for a, e in b)
