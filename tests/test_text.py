import pytest
from pyspark.sql import functions as F

from faultloom.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want",
    [
        ("\x1b[31m2024-01-01T00:00:00Z  boom\x1b[0m  \r\n\r\n[12:00:01] x\t\r\n\n", "boom\n\nx"),
        ("\n\n  a  ", "\n\n  a"),
        ("", ""),
        ("plain", "plain"),
        ("2024-01-01 00:00:00,123 - m", "- m"),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        (r"At C:\a\b.cs:12 in /usr/lib/x.so", "at <path>:<n> in <path>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 at 0xFF", "id <guid> at <hex>"),
        ("a-/x/y stays", "a-/x/y stays"),
    ],
)
def test_scrub(spark, raw, want):
    assert one(spark, raw, X.scrub) == want


def test_terms(spark):
    assert one(spark, "NU1101 nu1101 a 42 sys.text_json x-1", X.term_counts) == {"nu1101": 2, "sys.text_json": 1}
    assert one(spark, None, X.term_counts) is None
    assert one(spark, "", X.term_counts) == {}


def test_error_like_lines(spark):
    assert one(spark, "a\nError 1\nb\nFAILED 2", X.error_like_lines) == ["Error 1", "FAILED 2"]
    assert one(spark, "\n".join(f"l{i}" for i in range(9)), X.error_like_lines) == [f"l{i}" for i in range(4, 9)]
    assert one(spark, " \n", X.error_like_lines) == []


def test_window_keeps_head_and_tail(spark):
    raw = "\n".join(f"progress {i}" for i in range(2000))
    out = one(spark, raw, lambda c: X.window_text(c, 4000))
    assert len(out) <= 4000 and out.startswith("progress 0\n") and out.endswith("progress 1999") and "truncated" in out
    assert all(x.startswith("progress ") or x.startswith("[...") for x in out.split("\n"))
    assert one(spark, "short", lambda c: X.window_text(c, 4000)) == "short"


def test_context_and_line(spark):
    t = "one\n\nthree\nfour  \n\nsix"
    df = spark.createDataFrame([(t,)], "t string")
    r = df.select(
        X.line_number_at("t", F.lit(6)).alias("n"),
        X.context_before(X.lines("t"), F.lit(4)).alias("b"),
        X.context_after(X.lines("t"), F.lit(4)).alias("a"),
    ).first()
    assert (r.n, r.b, r.a) == (3, ["one", "", "three"], ["", "six"])


def test_small_functions(spark):
    df = spark.createDataFrame([("a/b.xml:: N.C.m(x) ", "ABCDEF1234", "abcdef1", 90.0, "x: 100%\n")], "s string, a string, b string, d double, e string")
    r = df.select(
        X.test_name("s").alias("t"), X.without_arguments(X.test_name("s")).alias("w"), X.same_commit("a", "b").alias("c"), X.humanize_seconds("d").alias("h"),
        X.annotation_text("e", True).alias("e"), X.report_path("s").alias("p"), X.interpolate(F.lit("do {x} {y}"), F.create_map(F.lit("x"), F.lit("it"))).alias("i"), X.json_object(F.lit('so: {"a": {"b": 1}} ok')).alias("j"),
        X.embedding_from_json(F.lit("[1, 2.5]")).alias("v"), X.embedding_from_json(F.lit("[]")).alias("v0"),
    ).first()
    assert (r.t, r.w, r.c, r.h, r.e, r.p, r.i, r.j) == ("N.C.m(x)", "N.C.m", True, "1.5m", "x%3A 100%25%0A", "a/b.xml", "do it {y}", '{"a": {"b": 1}}')
    assert r.v == [1.0, 2.5] and r.v0 is None


def test_templates_are_filled_in_one_pass(spark):
    caps = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("x"))
    assert one(spark, "{a}-{b}-{c}-{", lambda c: X.interpolate(c, caps)) == "{b}-x-{c}-{"
    assert one(spark, "", lambda c: X.interpolate(c, caps)) == "" and one(spark, None, lambda c: X.interpolate(c, caps)) is None


def test_nothing_is_cut_unless_asked_for(spark):
    long = "line\n" * 3_000_000
    assert one(spark, long, lambda c: F.length(X.window_text(c))) == len(long)


def test_terms_of_a_long_text_are_counted_in_time(spark):
    text = " ".join(f"word{i % 5000}" for i in range(200_000))
    got = one(spark, text, X.term_counts)
    assert len(got) == 5000 and set(got.values()) == {40} and one(spark, "", X.term_counts) == {}
