from pyspark.sql import functions as F

from faultloom.operators import assist, detect
from faultloom.operators.rules import Rule, alternatives, duplicates, lint, match_rules, override, renamed_groups, required_literal, rules_from, with_evidence
from faultloom.sources.packs import append_rule, load_packs, parse_pack

PACK = """
- {id: a-missing, ecosystem: java, match: 'package (?<name>\\S+) not found|cannot find (?<name>\\S+) here', confidence: 0.8, title: Missing, fix: 'Add {name} or {other}'}
- {id: b-any, match: 'not found', confidence: 0.8, notMatch: 'dry run'}
- {id: c-needs, ecosystem: dotnet, ecosystems: [node], match: 'boom', requires: 'build'}
- {id: d-off, enabled: false}
- {id: '', match: x}
"""


def test_pack_and_override(tmp_path):
    p = parse_pack(PACK)
    assert [r.id for r in p] == ["a-missing", "b-any", "c-needs", "d-off"] and not p[-1].enabled
    assert p[2].declared == ("dotnet", "node")
    merged = override(p, [Rule("B-ANY", "", enabled=False)])
    assert [r.enabled for r in merged if r.id == "B-ANY"] == [False] and len(merged) == 4
    assert duplicates([Rule("x", "a"), Rule("X", "b")], [Rule("x", "c")]) == (["x"], ["x"])
    (tmp_path / "a.yaml").write_text(PACK)
    (tmp_path / "b.yaml").write_text("[broken")
    assert len(load_packs(tmp_path, tmp_path)) == 4
    append_rule(tmp_path / "s.yaml", {"id": "n", "match": "m"})
    assert [r.id for r in parse_pack((tmp_path / "s.yaml").read_text())] == ["n"]


def test_pattern_tools():
    assert alternatives(r"a|b(c|d)|[|]|\|") == ["a", "b(c|d)", "[|]", r"\|"]
    assert renamed_groups(r"(?<x>a)|(?:b)(?<x>c)(d)[(]") == ("(a)|(?:b)(c)(d)[(]", {"x": [1, 2]})
    assert required_literal(r"error DXN1137: (\S+)") == "error dxn1137: "
    assert required_literal("a|b") == "" and required_literal(r"\w+") == ""
    assert lint(Rule("ok-id", "x (?<a>b)|y", fix="{a}")) == ["placeholder {a} is not captured by every branch"]
    assert len(lint(Rule("Bad Id", "(", confidence=0))) == 3


def test_matching(spark):
    logs = spark.createDataFrame(
        [(1, "java", "x\nPackage Foo.Bar NOT found\n\nend\nnot found"), (2, "Android", "cannot find Zed here"), (3, "python", "package q not found"), (4, None, "boom BUILD dry run not found"), (5, "node", "boom"), (6, "java", None)], "id int, ecosystem string, text string"
    )
    m = match_rules(logs, parse_pack(PACK))
    got = {r.id: [x.rule_id for x in r.matches] for r in m.collect()}
    assert got == {1: ["a-missing", "b-any"], 2: ["a-missing"], 3: ["b-any"], 4: ["c-needs"], 5: [], 6: []}
    ev = {(r.id, r.rule_id): r for r in with_evidence(m).collect()}
    r = ev[1, "a-missing"]
    assert (r["rank"], r.line_number, r.matched_line, r.captures, r.fix, r.before, r.after) == (1, 2, "Package Foo.Bar NOT found", {"name": "Foo.Bar"}, "Add Foo.Bar or {other}", ["x"], ["", "end", "not found"])
    assert ev[1, "b-any"].occurrences == 2 and ev[2, "a-missing"].captures == {"name": "Zed"}


def test_table_packs(spark):
    df = spark.createDataFrame([("x", None, ["go"], "boom", None), ("y", None, [], "boom", 0.9), ("z", "go", None, None, 0.1)], "id string, ecosystem string, ecosystems array<string>, match string, confidence double")
    p = rules_from(df)
    assert [(r.id, r.declared, r.confidence) for r in p] == [("x", ("go",), 0.5), ("y", ("generic",), 0.9)]


def test_detect(spark):
    df = spark.createDataFrame([("Traceback (most recent call last)",), ("caused by: x",), ("",), (None,), ("npm ERR! and node_modules; yarn install\n at x (a.js:1:2)",)], "t string")
    assert [r.e for r in df.select(detect.ecosystem(F.col("t")).alias("e")).collect()] == ["python", "generic", "generic", "generic", "node"]


def test_assist(spark):
    r = assist.draft_rule('Sure: {"id": "n-x", "match": "boom \\\\d+", "title": "t"} ok')
    assert r.id == "n-x" and assist.draft_problems(r, "boom 1") == []
    assert assist.draft_rule("none") is None
    assert "too broad" in " ".join(assist.draft_problems(Rule("a", ".*"), "x"))
    df = match_rules(spark.createDataFrame([(1, "java", "package a not found"), (2, "java", "?"), (3, "java", "bad")], "id long, ecosystem string, text string"), parse_pack(PACK))

    def ask(t):
        if t == "bad":
            raise RuntimeError
        return ("m", "why " + t, "fix")

    assert [tuple(r) for r in assist.suggestions(df, ask).collect()] == [(2, "m", "why ?", "fix")]
    e = assist.embeddings(df.select("id", "text"), assist.hashing_embedding).first().embedding
    assert abs(sum(x * x for x in e) - 1) < 1e-5


def test_jvm_and_python_agree_on_the_whole_pack(spark):
    """The same patterns over the same texts in a second engine."""
    regex = __import__("pytest").importorskip("regex")
    d = "/root/testdata/sf0.001"
    pack = rules_from(spark.read.parquet(f"{d}/rules.parquet"))
    logs = spark.read.parquet(f"{d}/analyses.parquet").select("id", F.lit("unknown").alias("ecosystem"), F.col("excerpt").alias("text"))
    got = {r.id: {(m.rule_id, m.captures["subject"], m.captures["peer"], m.occurrences) for m in r.matches} for r in match_rules(logs, pack).collect()}
    compiled = [(r, regex.compile(r.match, regex.I | regex.M)) for r in pack if r.enabled]
    guard = lambda p, t: regex.search(p, t, regex.I | regex.M)
    for row in logs.collect():
        want = set()
        for r, p in compiled:
            m = p.search(row.text)
            if m and (not r.requires or guard(r.requires, row.text)) and not (r.not_match and guard(r.not_match, row.text)):
                want.add((r.id, m["subject"].strip(), m["peer"].strip(), min(100, len(p.findall(row.text)))))
        assert got[row.id] == want


def test_the_prefilter_changes_no_match(spark):
    """Forms of rule packs with arguments that are no text, each with a text that it matches."""
    forms = [
        (r"(?:NoMethodError|NameError)\b[\s\S]{0,200}?(?:undefined (?:local variable or )?method [`'](?<name>[^'`]+)['`])", "NoMethodError: undefined method 'size'"),
        (r"^\s{0,1024}E\s{2,4096}(?:\w+Error)", "E   TypeError"),
        (r"a\p{Alpha}{2,30000}b", "axyzb"),
        (r"\p{javaLowerCase}+ no", "abc no"),
        (r"\x41bcdef\d", "Abcdef1"),
        (r"Abcdef\d", "Abcdef1"),
        (r"\x{41}bcdef\d", "Abcdef1"),
        (r"[^\]abcdefgh]+ no", "xyz no"),
        (r"[]abcdefgh]{1,20000} no", "]] no"),
        (r"(\w)\1{2,10000}", "aaaa"),
        (r"\Qa[bc\E {3,90000}end", "a[bc    end"),
        (r"(?x) a b c d e f", "abcdef"),
    ]
    rules = [Rule(f"r{i}", p) for i, (p, _) in enumerate(forms)]
    guarded = [Rule(f"g{i}", "[a-z]", not_match=p) for i, (p, _) in enumerate(forms)]
    logs = spark.createDataFrame([(i, "generic", t) for i, (_, t) in enumerate(forms)], "id int, ecosystem string, text string")
    for r in match_rules(logs, rules + guarded).collect():
        got = {m.rule_id for m in r.matches}
        assert f"r{r.id}" in got and f"g{r.id}" not in got, (forms[r.id], got)
    assert required_literal(r"missing header \d{1,3}") == "missing header " and required_literal(r"undefined reference\p{Alpha}{2,20}x") == "undefined reference"


def test_a_rule_that_does_not_compile_is_left_out(spark, caplog):
    from faultloom.operators import rules as R

    good, bad, guard = R.Rule("good", "boom", confidence=0.5), R.Rule("bad", "(?<x>[a-z", confidence=0.9), R.Rule("guard", "boom", confidence=0.8, not_match="(")
    df = spark.createDataFrame([(1, "boom"), (2, "quiet")], "id long, text string").selectExpr("*", "'generic' AS ecosystem")
    got = {r.id: [m.rule_id for m in r.matches] for r in R.match_rules(df, [bad, good, guard]).collect()}
    assert got == {1: ["good"], 2: []} and "bad" in caplog.text


def test_precedence_and_hand_written_detections(spark):
    """Expected names were written by hand, line by line."""
    from pyspark.sql import functions as F

    from faultloom.operators import detect as D

    cases = {
        "error CS1002: ; expected": "dotnet", "npm ERR! code ERESOLVE": "node", "Traceback (most recent call last):": "python", "[INFO] BUILD FAILURE": "java", "BUILD FAILED in 12s": "java", "e: /src/A.kt:3:1 unresolved": "java",
        "go: cannot find package \"x\"": "go", "error[E0382]: borrow of moved value": "rust", "rake aborted!": "ruby", "PHP Fatal error:  Uncaught": "php", "main.o: undefined reference to `f'": "cpp",
        "Step 3/9 : RUN make": "infra", "pod is in CrashLoopBackOff": "infra", "** BUILD FAILED **": "swift", "[error] A.scala:10: type mismatch": "scala", "** (CompileError) lib/a.ex:3": "elixir", "Execution failed for task ':app:mergeDebugResources'.": "android",
        "yarn 1.22": "generic", "a hidden gem": "generic", "permission denied: x": "generic", "plain words": "generic", "python3 runs pytest": "python", "gradlew": "generic", "ran gradle with gradlew": "java",
        # equal points: the earlier in the order of precedence wins
        "Cargo.toml beside go.mod": "rust", "Dockerfile beside cmake": "cpp", "aapt then xcodebuild": "android", "composer then Gemfile": "php",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", D.ecosystem(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []
