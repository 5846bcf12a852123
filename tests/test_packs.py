"""Every ecosystem has a pack whose rules are sound and find a line written by hand for each."""

from faultloom.operators import detect, rules
from faultloom.sources import packs

LINES = {
    "dotnet-compiler-message": "A.cs(1,2): error CS1002: ; expected [/src/A.csproj]", "dotnet-package-missing": "error NU1101: Unable to find package Abc.", "node-peer-conflict": "npm ERR! code ERESOLVE", "node-module-absent": "Error: Cannot find module './x'",
    "python-no-module": "ModuleNotFoundError: No module named 'abc'", "python-test": "FAILED tests/test_a.py::test_b - assert 1 == 2", "java-symbol": "src/A.java:3: error: cannot find symbol", "java-heap": "java.lang.OutOfMemoryError: Java heap space",
    "go-unknown-name": "./a.go:3:5: undefined: foo", "go-race": "WARNING: DATA RACE", "rust-compiler": "error[E0382]: borrow of moved value", "ruby-load": "cannot load such file -- abc (LoadError)", "php-fatal": "PHP Fatal error:  Uncaught Error",
    "cpp-undefined-symbol": "undefined reference to `f()'", "cpp-header": "fatal error: a/b.h: No such file or directory", "infra-state-lock": "Error: Error acquiring the state lock", "swift-module": "error: no such module 'Abc'", "android-sdk": "SDK location not found.",
    "scala-compiler": "[error] /src/A.scala:10:3: type mismatch", "elixir-compiler": "** (CompileError) lib/a.ex:3: undefined variable", "generic-disk": "write: No space left on device", "generic-killed": "Process exited with code 137",
}


def test_all_ecosystems_have_sound_packs(spark):
    pack = packs.built_in()
    assert {r.ecosystem for r in pack} == {*detect.MARKERS, "generic"} and len({r.id for r in pack}) == len(pack) > 70
    assert [(r.id, p) for r in pack for p in rules.lint(r)] == [] and rules.usable(pack) == sorted(pack, key=lambda r: r.id)


def test_lines_written_by_hand(spark):
    df = spark.createDataFrame([(k, t, k.split("-")[0]) for k, t in LINES.items()], "want string, text string, ecosystem string")
    got = {r.want: {m.rule_id: m for m in r.matches} for r in rules.match_rules(df, packs.built_in()).collect()}
    assert [k for k in LINES if k not in got[k]] == []
    assert got["java-symbol"]["java-symbol"].captures["message"] == "cannot find symbol" and got["go-unknown-name"]["go-unknown-name"].captures["name"] == "foo"
