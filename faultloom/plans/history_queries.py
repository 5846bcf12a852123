"""Queries over the failure history, the baseline, test reports and the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions import text as X
from faultloom.operators import gate as G
from faultloom.operators import history as H
from faultloom.operators import reconcile as R
from faultloom.operators import selection as S
from faultloom.operators import stats as A
from faultloom.session import table

SINCE = "2026-03-01 00:00:00"
REPO = "0e8683a0bf44026a0af0e921e97977d9fd6ba981"
QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _h(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "analyses")


def _us(c: str):
    return F.unix_micros(c).alias(f"{c}_us")


@query("SELECT count(*)::BIGINT AS total, (count(*) - count(*) FILTER (status = 'resolved'))::BIGINT AS open, (count(*) FILTER (status = 'resolved'))::BIGINT AS resolved, (count(*) FILTER (NOT matched))::BIGINT AS unmatched FROM analyses")
def stats_totals(s, d):
    return A.totals(_h(s, d))


@query(f"SELECT count(*)::BIGINT AS total, (count(*) - count(*) FILTER (status = 'resolved'))::BIGINT AS open, (count(*) FILTER (status = 'resolved'))::BIGINT AS resolved, (count(*) FILTER (NOT matched))::BIGINT AS unmatched FROM analyses WHERE analyzed_at >= TIMESTAMPTZ '{SINCE}+00' AND repo_id = '{REPO}'")
def stats_totals_scoped(s, d):
    return A.totals(H.scoped(_h(s, d), SINCE, REPO))


@query("SELECT CASE WHEN trim(coalesce(ecosystem, '')) = '' THEN 'unknown' ELSE ecosystem END AS ecosystem, count(*)::BIGINT AS n FROM analyses GROUP BY 1")
def by_ecosystem(s, d):
    return A.by_ecosystem(_h(s, d))


_FP = """
    SELECT fingerprint, count(*)::BIGINT AS n, (count(*) FILTER (status = 'open'))::BIGINT AS open_count, epoch_us(max(analyzed_at)) AS last_seen_us,
        coalesce(max(analyzed_at) > min(resolved_at), false) AS flaky,
        first(rule_id ORDER BY matched DESC, id DESC) AS rule_id
    FROM analyses GROUP BY fingerprint
"""


def _fp(df: DataFrame) -> DataFrame:
    return df.select("fingerprint", "n", "open_count", _us("last_seen"), "flaky", "rule_id")


@query(_FP)
def fingerprint_stats(s, d):
    return _fp(A.fingerprint_stats(_h(s, d)))


@query(f"SELECT * FROM ({_FP}) ORDER BY n DESC, last_seen_us DESC, fingerprint LIMIT 10")
def top_failures(s, d):
    return _fp(A.top_failures(_h(s, d)))


@query(f"SELECT * FROM ({_FP}) WHERE flaky")
def flaky_failures(s, d):
    return _fp(A.flaky_failures(_h(s, d)))


@query(f"SELECT fingerprint, CASE WHEN flaky THEN 'flaky' WHEN open_count = 0 THEN 'resolved' WHEN open_count = n THEN 'open' ELSE open_count || ' open' END AS state FROM ({_FP})")
def failure_states(s, d):
    return A.fingerprint_stats(_h(s, d)).select("fingerprint", X.state_label("flaky", "open_count", "n").alias("state"))


@query(f"SELECT round_even(count(*) FILTER (n > 1) / count(*)::DOUBLE, 4) AS recurrence_rate, count(*)::BIGINT AS fingerprints FROM (SELECT fingerprint, count(*) AS n FROM analyses WHERE analyzed_at >= TIMESTAMPTZ '{SINCE}+00' GROUP BY 1)")
def recurrence_rate(s, d):
    return A.recurrence_rate(H.scoped(_h(s, d), SINCE)).select(F.bround("recurrence_rate", 4).alias("recurrence_rate"), "fingerprints")


@query("SELECT count(*)::BIGINT AS n, (sum(epoch_us(resolved_at) - epoch_us(analyzed_at)) // count(*) // 1000000)::BIGINT AS mean_seconds FROM analyses WHERE resolved_at >= analyzed_at")
def time_to_resolve(s, d):
    return A.time_to_resolve(_h(s, d)).select("n", F.floor(F.col("mean_us") / 1_000_000).cast("long").alias("mean_seconds"))


@query("""
    WITH t AS (SELECT max(analyzed_at)::DATE AS today FROM analyses)
    SELECT day::DATE AS day, count(id)::BIGINT AS n FROM (SELECT unnest(generate_series(today - INTERVAL 29 DAY, today::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM t) s
    LEFT JOIN analyses a ON a.analyzed_at::DATE = s.day::DATE GROUP BY 1
""")
def daily_counts(s, d):
    h = _h(s, d)
    return A.daily_counts(h, h.agg(F.to_date(F.max("analyzed_at"))).first()[0])


_TEST = """
    SELECT trim(substr(source, instr(source, '::') + 2)) AS test, count(*)::BIGINT AS failures, count(DISTINCT analyzed_at::DATE)::BIGINT AS days,
        (count(*) FILTER (status = 'open'))::BIGINT AS open_count, epoch_us(max(analyzed_at)) AS last_seen_us, coalesce(max(analyzed_at) > min(resolved_at), false) AS flaky
    FROM analyses WHERE instr(source, '::') > 0 AND trim(substr(source, instr(source, '::') + 2)) <> '' GROUP BY 1
"""


def _test(df: DataFrame) -> DataFrame:
    return df.select("test", "failures", "days", "open_count", _us("last_seen"), "flaky")


@query(_TEST)
def test_stats(s, d):
    return _test(A.test_stats(_h(s, d)))


@query(f"SELECT * FROM ({_TEST}) ORDER BY failures DESC, flaky DESC, last_seen_us DESC, test LIMIT 20")
def top_tests(s, d):
    return _test(A.top_tests(_h(s, d)))


@query(f"SELECT sum(failures)::BIGINT AS failures, count(*)::BIGINT AS tests, (count(*) FILTER (flaky))::BIGINT AS flaky FROM ({_TEST})")
def test_totals(s, d):
    return A.test_totals(_h(s, d))


@query(f"SELECT id, fingerprint FROM analyses WHERE analyzed_at >= TIMESTAMPTZ '{SINCE}+00' AND status = 'open' AND lower(ecosystem) = 'java' AND (contains(lower(source), 'timeout_1') OR contains(lower(fingerprint), 'lock') OR contains(lower(excerpt), 'expected'))")
def history_filter(s, d):
    h = H.filtered(_h(s, d), since=SINCE, status="open", ecosystem="Java")
    a, b, c = (H.filtered(h, search=q).select("id", "fingerprint") for q in ("TIMEOUT_1", "Lock", "EXPECTED"))
    return a.union(b).union(c).distinct()


@query("SELECT id FROM analyses WHERE contains(lower(source), 'deploy-check') OR contains(lower(fingerprint), 'deploy-check') OR contains(lower(excerpt), 'deploy-check')")
def history_search(s, d):
    return H.filtered(_h(s, d), search="Deploy-Check").select("id")


@query("SELECT id, epoch_us(analyzed_at) AS analyzed_at_us, source, rule_id FROM analyses ORDER BY id DESC LIMIT 50 OFFSET 100")
def history_page(s, d):
    return H.page(_h(s, d), 50, 100).select("id", _us("analyzed_at"), "source", "rule_id")


@query(f"SELECT id, fingerprint, git_commit FROM analyses WHERE status = 'open' AND repo_id = '{REPO}'")
def open_failures(s, d):
    return H.open_failures(_h(s, d), REPO).select("id", "fingerprint", "git_commit")


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY fingerprint ORDER BY id) > 1 THEN 'recurrence' ELSE 'new-failure' END AS event FROM analyses")
def new_or_recurring(s, d):
    return H.new_or_recurring(_h(s, d))


@query(f"SELECT id FROM analyses WHERE NOT (analyzed_at < TIMESTAMPTZ '{SINCE}+00' AND coalesce(status = 'resolved', false))")
def prune_survivors(s, d):
    return H.prune_survivors(_h(s, d), SINCE, resolved_only=True).select("id")


@query("SELECT id, coalesce(status, CASE WHEN resolution IS NOT NULL THEN 'resolved' ELSE 'open' END) AS status FROM analyses")
def status_backfill(s, d):
    return H.backfill_status(_h(s, d)).select("id", "status")


_SPELLED = " ".join(f"WHEN lower(trim(ecosystem)) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in H.ECOSYSTEM_NAMES.items())


@query(f"SELECT id, CASE {_SPELLED} ELSE 'unknown' END AS ecosystem FROM analyses")
def ecosystem_names(s, d):
    return _h(s, d).select("id", H.ecosystem_name("ecosystem").alias("ecosystem"))


# resolution events: every third open row is resolved automatically, every seventh row by hand, later
@query("""
    SELECT id, CASE WHEN id % 7 = 0 THEN 'by hand ' || id WHEN id % 3 = 0 AND coalesce(status, 'open') = 'open' THEN 'auto ' || id ELSE resolution END AS resolution,
        CASE WHEN id % 7 = 0 THEN 'manual' WHEN id % 3 = 0 AND coalesce(status, 'open') = 'open' THEN 'auto' ELSE resolution_source END AS resolution_source,
        CASE WHEN id % 3 = 0 AND coalesce(status, 'open') = 'open' THEN 'abc' || id ELSE resolved_commit END AS resolved_commit,
        CASE WHEN id % 7 = 0 OR (id % 3 = 0 AND coalesce(status, 'open') = 'open') THEN 'resolved' ELSE status END AS status
    FROM analyses
""")
def resolution_fold(s, d):
    h = _h(s, d)
    auto = h.where("id % 3 = 0").select("id", F.lit(1).alias("seq"), F.lit("auto").alias("kind"), F.concat(F.lit("auto "), "id").alias("note"), F.col("analyzed_at").alias("at"), F.concat(F.lit("abc"), "id").alias("commit"))
    hand = h.where("id % 7 = 0").select("id", F.lit(2).alias("seq"), F.lit("manual").alias("kind"), F.concat(F.lit("by hand "), "id").alias("note"), F.col("analyzed_at").alias("at"), F.lit(None).cast("string").alias("commit"))
    return H.fold_resolutions(h, auto.union(hand)).select("id", "resolution", "resolution_source", "resolved_commit", "status")


_BASE = r"SELECT DISTINCT regexp_extract(line, '^\s*([^\s#]+)', 1) AS fingerprint FROM baseline WHERE regexp_extract(line, '^\s*([^\s#]+)', 1) <> ''"


@query(_BASE)
def baseline_tokens(s, d):
    return G.baseline_tokens(table(s, d, "baseline"))


def _gate(s, d):
    seen = _h(s, d).select("fingerprint", "source", "rule_id", F.lit(None).cast("string").alias("title"), F.col("id").alias("seq"))
    return G.gate(seen, G.baseline_tokens(table(s, d, "baseline")))


_GROUPED = f"""
    WITH b AS ({_BASE})
    SELECT fingerprint, source, min(id) AS seq, first(first(rule_id ORDER BY id)) OVER (PARTITION BY fingerprint ORDER BY min(id)) AS rule_id FROM analyses WHERE fingerprint {{}} (SELECT fingerprint FROM b) GROUP BY fingerprint, source
"""


@query(_GROUPED.format("NOT IN"))
def gate_new(s, d):
    return _gate(s, d)[0].drop("title")


@query(_GROUPED.format("IN"))
def gate_known(s, d):
    return _gate(s, d)[1].drop("title")


@query(f"SELECT fingerprint FROM ({_BASE}) WHERE fingerprint NOT IN (SELECT fingerprint FROM analyses WHERE fingerprint IS NOT NULL)")
def gate_stale(s, d):
    return _gate(s, d)[2]


# the selection: tests of the history's sources were skipped, by the first part of their name; one assembly was skipped whole
_SKIPPED = """
    skipped AS (SELECT test, min(project) AS project FROM (
        SELECT trim(split_part(t, '(', 1)) AS test, split_part(t, '.', 1) AS project
        FROM (SELECT trim(substr(source, instr(source, '::') + 2)) AS t FROM analyses WHERE instr(source, '::') > 0) WHERE t <> '') GROUP BY test)
"""

def _failures(s, d) -> DataFrame:
    """Distinct failures with a content hash as their number, so that numbering needs no sort."""
    cols = ["source", "name", "classname", "method", "assembly", "full_name", "message"]
    return table(s, d, "test_failures").select(*cols).distinct().withColumn("seq", F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in cols]), 256), 1, 15), 16, 10).cast("long"))


def _skipped(s, d) -> DataFrame:
    t = X.test_name("source")
    return _h(s, d).select(X.without_arguments(t).alias("test"), F.substring_index(t, ".", 1).alias("project")).where("test IS NOT NULL AND test <> ''").groupBy("test").agg(F.min("project").alias("project"))


def _projects(s) -> DataFrame:
    return s.createDataFrame([("Vijuzon", "vijuzon.tests"), ("Nameless", None)], "project string, assembly string")


_KEY = "('0x' || substr(sha256(concat_ws('|', coalesce(source, '~'), coalesce(name, '~'), coalesce(classname, '~'), coalesce(method, '~'), coalesce(assembly, '~'), coalesce(full_name, '~'), coalesce(message, '~'))), 1, 15))::BIGINT AS seq"
_MISSES = f"""
    WITH {_SKIPPED}, f AS (SELECT {_KEY}, * FROM (SELECT DISTINCT source, name, classname, method, assembly, full_name, message FROM test_failures)),
    c AS (
        SELECT seq, 1 AS pos, trim(split_part(full_name, '(', 1)) AS test FROM f WHERE lower(coalesce(assembly, '')) <> 'vijuzon.tests'
        UNION ALL SELECT seq, 2, trim(split_part(name, '(', 1)) FROM f WHERE lower(coalesce(assembly, '')) <> 'vijuzon.tests'
        UNION ALL SELECT seq, 3, trim(split_part(classname || '.' || method, '(', 1)) FROM f WHERE classname <> '' AND method <> '' AND lower(coalesce(assembly, '')) <> 'vijuzon.tests'
    ), e AS (SELECT seq, first(test ORDER BY pos) AS test, first(project ORDER BY pos) AS project FROM c JOIN skipped USING (test) GROUP BY seq),
    o AS (SELECT seq, trim(split_part(CASE WHEN method <> '' THEN method ELSE name END, '(', 1)) AS suffix FROM f
        WHERE lower(coalesce(assembly, '')) <> 'vijuzon.tests' AND seq NOT IN (SELECT seq FROM e) AND NOT (method IS NOT NULL AND trim(coalesce(classname, '')) <> '')),
    x AS (SELECT seq, count(*) AS n, min(test) AS test, first(project ORDER BY test) AS project FROM o JOIN skipped s ON ends_with(s.test, '.' || suffix) WHERE suffix <> '' GROUP BY seq),
    m AS (SELECT seq, trim(split_part(full_name, '(', 1)) AS test, 'Vijuzon' AS project, 'project' AS how, 1 AS n_candidates FROM f WHERE lower(assembly) = 'vijuzon.tests'
        UNION ALL SELECT seq, test, project, 'exact', 1 FROM e
        UNION ALL SELECT seq, CASE WHEN n = 1 THEN test END, CASE WHEN n = 1 THEN project END, CASE WHEN n = 1 THEN 'suffix' ELSE 'ambiguous' END, n FROM x)
"""


@query(f"{_MISSES} SELECT seq, test, project, how, n_candidates::BIGINT AS n_candidates FROM m")
def selection_misses(s, d):
    return S.misses(_failures(s, d), _skipped(s, d), _projects(s))


@query(f"{_MISSES} SELECT m.seq, m.test, m.project, m.how, m.n_candidates::BIGINT AS n_candidates FROM m JOIN f USING (seq) QUALIFY m.seq = min(m.seq) OVER (PARTITION BY coalesce(m.test, '?' || f.full_name))")
def selection_first_reports(s, d):
    f = _failures(s, d)
    return S.first_reports(S.misses(f, _skipped(s, d), _projects(s)), f)


@query(f"""{_MISSES}, t AS (SELECT trim(split_part(substr(source, instr(source, '::') + 2), '(', 1)) AS test, count(*) AS failures FROM analyses
        WHERE instr(source, '::') > 0 AND (repo_id IS NULL OR repo_id = '{REPO}') AND trim(substr(source, instr(source, '::') + 2)) <> '' GROUP BY 1)
    SELECT m.seq, m.test, m.how, coalesce(a.failures, b.failures, 0)::BIGINT AS failures FROM m JOIN f USING (seq) LEFT JOIN t a ON a.test = m.test LEFT JOIN t b ON b.test = trim(split_part(f.full_name, '(', 1))
""")
def selection_history(s, d):
    f = _failures(s, d)
    return S.with_history(S.misses(f, _skipped(s, d), _projects(s)), f, _h(s, d), REPO).select("seq", "test", "how", "failures")


_HEADS = "heads AS (SELECT repo_id, max(sha) AS head FROM (SELECT repo_id, sha FROM commits EXCEPT SELECT repo_id, unnest(parents) FROM commits) GROUP BY 1)"


@query(f"WITH {_HEADS} SELECT repo_id, head FROM heads")
def commit_heads(s, d):
    return R.heads(table(s, d, "commits"))


_REACH = f"""
    WITH RECURSIVE {_HEADS}, edge AS (SELECT DISTINCT repo_id, sha, unnest(parents) AS parent FROM commits),
    reach AS (SELECT repo_id, head, head AS sha FROM heads UNION SELECT r.repo_id, r.head, e.parent FROM reach r JOIN edge e ON e.repo_id = r.repo_id AND e.sha = r.sha)
"""


@query(f"{_REACH} SELECT repo_id, head, sha FROM reach")
def ancestor_set(s, d):
    c = table(s, d, "commits")
    return R.ancestors(c, R.heads(c).select("repo_id", F.col("head").alias("start"))).select("repo_id", F.col("start").alias("head"), "sha")


@query(f"""
    WITH RECURSIVE {_HEADS}, edge AS (SELECT DISTINCT repo_id, sha, unnest(parents) AS parent FROM commits),
    p AS (SELECT h.repo_id, h.head AS new, (SELECT min(parent) FROM edge e WHERE e.repo_id = h.repo_id AND e.sha = h.head) AS old FROM heads h),
    q AS (SELECT repo_id, new, coalesce((SELECT min(parent) FROM edge e WHERE e.repo_id = p.repo_id AND e.sha = p.old), old) AS old FROM p WHERE old IS NOT NULL),
    rn AS (SELECT repo_id, old, new, new AS sha FROM q UNION SELECT r.repo_id, r.old, r.new, e.parent FROM rn r JOIN edge e ON e.repo_id = r.repo_id AND e.sha = r.sha),
    ro AS (SELECT repo_id, old, new, old AS sha FROM q UNION SELECT r.repo_id, r.old, r.new, e.parent FROM ro r JOIN edge e ON e.repo_id = r.repo_id AND e.sha = r.sha)
    SELECT repo_id, old, new, sha FROM rn EXCEPT SELECT repo_id, old, new, sha FROM ro
""")
def commits_between(s, d):
    c = table(s, d, "commits")
    e = c.select("repo_id", "sha", F.explode("parents").alias("parent")).groupBy("repo_id", "sha").agg(F.min("parent").alias("parent"))
    p = R.heads(c).withColumnRenamed("head", "new").join(e.withColumnRenamed("sha", "new").withColumnRenamed("parent", "old"), ["repo_id", "new"])
    q = p.join(e.withColumnRenamed("sha", "old"), ["repo_id", "old"], "left").select("repo_id", "new", F.coalesce("parent", "old").alias("old"))
    return R.commits_between(c, q)


@query(f"""{_REACH}, o AS (SELECT DISTINCT a.fingerprint FROM analyses a JOIN heads h ON h.repo_id = a.repo_id AND h.head = a.git_commit)
    SELECT a.id, a.fingerprint, r.head FROM analyses a JOIN reach r ON r.repo_id = a.repo_id AND r.sha = a.git_commit
    WHERE a.status = 'open' AND a.git_commit <> '' AND a.git_commit <> r.head AND a.fingerprint NOT IN (SELECT fingerprint FROM o WHERE fingerprint IS NOT NULL)
""")
def likely_fixed(s, d):
    h, c = _h(s, d), table(s, d, "commits")
    heads = R.heads(c)
    observed = h.join(heads, (h.repo_id == heads.repo_id) & (h.git_commit == heads["head"])).select("fingerprint")
    return R.likely_fixed(h, c, heads, observed)


@query(r"""
    SELECT DISTINCT full_name, trim(split_part(full_name, '(', 1)) AS plain, regexp_replace(regexp_extract(assembly, '([^/\\]*)$', 1), '(?i)\.(dll|exe)$', '') AS assembly_name,
        trim(split_part(classname, ',', 1)) AS class_name FROM test_failures
""")
def test_names(s, d):
    return table(s, d, "test_failures").select("full_name", X.without_arguments("full_name").alias("plain"), X.assembly_name("assembly").alias("assembly_name"), X.class_name("classname").alias("class_name")).distinct()


@query("SELECT repo_id, sha, substr(split_part(subject, chr(10), 1), 1, 70) AS title, substr(sha, 1, 7) AS short FROM commits")
def commit_titles(s, d):
    return table(s, d, "commits").select("repo_id", "sha", X.first_line("subject", 70).alias("title"), X.short_sha("sha").alias("short"))


@query(r"SELECT id, CASE WHEN trim(coalesce(split_part(source, '::', 1), '')) = '' THEN 'stdin' ELSE replace(split_part(source, '::', 1), '\', '/') END AS path, split_part(fingerprint, ':', 1) AS rule FROM analyses")
def report_paths(s, d):
    return _h(s, d).select("id", X.report_path("source").alias("path"), X.fingerprint_rule("fingerprint").alias("rule"))


@query("SELECT DISTINCT lower(ecosystem) AS ecosystem FROM analyses WHERE ecosystem <> ''")
def ecosystem_choices(s, d):
    return _h(s, d).where("ecosystem <> ''").select(F.lower("ecosystem").alias("ecosystem")).distinct()
