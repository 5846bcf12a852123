"""Queries of further operators over whole tables: text functions, rule packs, result documents,
reports, reconciling, appending and pruning."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions import text as X
from faultloom.operators import assist, history, reconcile, stats
from faultloom.operators import detect as D
from faultloom.operators import rules as R
from faultloom.operators import similarity as V
from faultloom.plans import history_queries, log_queries, pipeline
from faultloom.plans.log_queries import _MATCHES, _SCORES, _pack
from faultloom.sinks import outputs
from faultloom.session import Scratch, spread, table
from faultloom.sources import packs, reports
from faultloom.streaming import events

NOW = datetime(2026, 3, 1, tzinfo=timezone.utc)
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


def _logs(s: SparkSession, d: str) -> DataFrame:
    return spread(_h(s, d).select("id", "source", "ecosystem", "fingerprint", F.col("excerpt").alias("text")))


@query(r"""
    WITH t AS (SELECT id, excerpt AS t, left(excerpt, 150) AS h, right(excerpt, 425) AS r FROM analyses)
    SELECT id, CASE WHEN length(t) <= 600 THEN t ELSE (CASE WHEN contains(h, chr(10)) THEN left(h, length(h) - strpos(reverse(h), chr(10))) ELSE h END)
        || chr(10) || '[... log truncated ...]' || chr(10) || (CASE WHEN contains(r, chr(10)) THEN substr(r, strpos(r, chr(10)) + 1) ELSE r END) END AS shown FROM t
""")
def window_logs(s, d):
    """Logs cut to a window of 600 characters: the cut itself is what is asked for."""
    return _h(s, d).select("id", X.window_text("excerpt", 600).alias("shown"))


@query("SELECT id, sha256(excerpt) AS log_hash FROM analyses")
def log_hashes(s, d):
    return _h(s, d).select("id", X.log_hash("excerpt").alias("log_hash"))


@query(r"""
    WITH l AS (SELECT id, list_transform(string_split(excerpt, chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS ls FROM analyses),
    n AS (SELECT id, ls, list_position(list_transform(ls, lambda x: regexp_matches(lower(x), 'error|fail')), true) AS n FROM l),
    b AS (SELECT id, n, ls[greatest(1, n - 3):n - 1] AS pre, ls[n + 1:n + 3] AS post FROM n WHERE n > 0)
    SELECT id, n::INT AS line, array_to_string(CASE WHEN len(list_filter(pre, lambda x: x <> '')) = 0 THEN [] ELSE pre[list_position(list_transform(pre, lambda x: x <> ''), true):] END, chr(10)) AS above,
        array_to_string(CASE WHEN len(list_filter(post, lambda x: x <> '')) = 0 THEN [] ELSE post[:len(post) + 1 - list_position(list_transform(list_reverse(post), lambda x: x <> ''), true)] END, chr(10)) AS below FROM b
""")
def line_contexts(s, d):
    """Up to three lines around the first line that speaks of an error."""
    ls = F.transform(X.lines("excerpt"), lambda x: F.regexp_replace(x, r"\s+\z", ""))
    x = _h(s, d).select("id", ls.alias("ls")).withColumn("n", F.array_position(F.transform("ls", lambda x: F.lower(x).rlike("error|fail")), True).cast("int")).where("n > 0")
    return x.select("id", F.col("n").alias("line"), F.array_join(X.context_before(F.col("ls"), F.col("n")), "\n").alias("above"), F.array_join(X.context_after(F.col("ls"), F.col("n")), "\n").alias("below"))


@query("SELECT id, replace(replace('{id}: {title} {missing}', '{id}', id), '{title}', coalesce(title, '')) AS filled FROM rules")
def filled_templates(s, d):
    t = table(s, d, "rules")
    return t.select("id", X.interpolate(F.lit("{id}: {title} {missing}"), F.create_map(F.lit("id"), F.col("id"), F.lit("title"), F.coalesce("title", F.lit("")))).alias("filled"))


@query("""SELECT id, coalesce(length(git_commit) >= 7 AND length(resolved_commit) >= 7 AND (starts_with(lower(git_commit), lower(resolved_commit)) OR starts_with(lower(resolved_commit), lower(git_commit))), false) AS same,
    substr(resolved_commit, 1, 7) AS short FROM analyses""")
def same_commits(s, d):
    return _h(s, d).select("id", X.same_commit("git_commit", "resolved_commit").alias("same"), X.short_sha("resolved_commit").alias("short"))


@query("SELECT id, CASE WHEN level = 'error' THEN 'major' WHEN level = 'warning' THEN 'minor' ELSE 'info' END AS severity FROM (SELECT id, CASE WHEN severity IN ('error', 'warning', 'note') THEN severity WHEN confidence >= 0.8 THEN 'error' WHEN confidence >= 0.6 THEN 'warning' ELSE 'note' END AS level FROM rules)")
def quality_severities(s, d):
    return table(s, d, "rules").select("id", X.quality_severity(X.sarif_level("confidence", "severity")).alias("severity"))


@query(r"SELECT id, replace(replace(replace(excerpt, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') AS label FROM analyses")
def metric_labels(s, d):
    return _h(s, d).select("id", X.prometheus_label("excerpt").alias("label"))


@query("""SELECT id, replace(replace(replace(excerpt, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS message,
    replace(replace(replace(replace(replace(source, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS property FROM analyses""")
def escaped_annotations(s, d):
    return _h(s, d).select("id", X.annotation_text("excerpt").alias("message"), X.annotation_text("source", True).alias("property"))


@query("""SELECT id, CASE WHEN row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1 THEN 'New failure: ' ELSE 'Recurring failure: ' END || rule_id AS title FROM analyses WHERE fingerprint IS NOT NULL AND rule_id IS NOT NULL""")
def event_titles(s, d):
    h = _h(s, d)
    x = history.new_or_recurring(h).join(h.select("id", "rule_id"), "id").where("rule_id IS NOT NULL")
    return x.select("id", X.event_title("event", "rule_id").alias("title"))


@query(r"""WITH a AS (SELECT id, (epoch_us(resolved_at) - epoch_us(analyzed_at)) / 1000000.0::DOUBLE AS s FROM analyses WHERE resolved_at >= analyzed_at)
    SELECT id, CASE WHEN s >= 86400 THEN regexp_replace(round_even(s / 86400, 1)::VARCHAR, '\.0$', '') || 'd' WHEN s >= 3600 THEN regexp_replace(round_even(s / 3600, 1)::VARCHAR, '\.0$', '') || 'h'
        WHEN s >= 60 THEN regexp_replace(round_even(s / 60, 1)::VARCHAR, '\.0$', '') || 'm' ELSE regexp_replace(round_even(s, 1)::VARCHAR, '\.0$', '') || 's' END AS took FROM a""")
def resolution_times(s, d):
    x = _h(s, d).where("resolved_at >= analyzed_at").select("id", ((F.unix_micros("resolved_at") - F.unix_micros("analyzed_at")) / 1e6).alias("s"))
    return x.select("id", X.humanize_seconds("s").alias("took"))


@query(r"SELECT id, nullif(regexp_extract(excerpt, '(?s)\{.*\}'), '') AS found FROM analyses")
def embedded_objects(s, d):
    return _h(s, d).select("id", X.json_object("excerpt").alias("found"))


@query("SELECT vec_id, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vectors_from_json(s, d):
    v = X.embedding_from_json(F.to_json("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.size(v).alias("size"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT status, count(*)::BIGINT AS n FROM analyses WHERE analyzed_at >= TIMESTAMPTZ '2026-01-30 00:00:00+00' GROUP BY 1")
def since_days(s, d):
    return history.scoped(_h(s, d), history.parse_since("30d", NOW)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n_before, (count(*) FILTER (analyzed_at < TIMESTAMPTZ '2025-12-31 00:00:00+00' AND status = 'resolved'))::BIGINT AS n_gone, (count(*) FILTER (NOT coalesce(analyzed_at < TIMESTAMPTZ '2025-12-31 00:00:00+00' AND status = 'resolved', false)))::BIGINT AS n_left FROM analyses")
def prune_dry_run(s, d):
    """What a pruning to two months would delete, without deleting."""
    h = _h(s, d)
    left = history.prune_survivors(h, NOW - history.parse_duration("2mo"), True)
    return h.agg(F.count("*").alias("n_before")).join(left.agg(F.count("*").alias("n_left")), F.lit(True)).select("n_before", (F.col("n_before") - F.col("n_left")).alias("n_gone"), "n_left")


@query("SELECT count(*)::BIGINT AS total, greatest(1, (count(*) + 49) // 50)::BIGINT AS pages FROM analyses WHERE status = 'open'")
def open_pages(s, d):
    n = history.open_failures(_h(s, d)).count()
    return s.createDataFrame([(n, history.page_count(n))], "total long, pages long")


@query("SELECT row_number() OVER (ORDER BY record_id) + (SELECT max(id) FROM analyses) AS id, record_id, 'open' AS status FROM incoming")
def appended_ids(s, d):
    new = table(s, d, "incoming").select("record_id", F.col("record_id").alias("seq"))
    return history.next_ids(_h(s, d), new).select("id", "record_id", "status")


@query("SELECT id, CASE WHEN confidence >= 0.8 THEN 'own title' ELSE title END AS title, coalesce(enabled, true) AS enabled FROM rules WHERE trim(id) <> '' AND (NOT coalesce(enabled, true) OR trim(match) <> '')")
def overridden_rules(s, d):
    """A pack over which a later tier, ids in capitals, lays its own titles for the surest rules."""
    from dataclasses import replace

    own = _pack(s, d)
    later = [replace(r, id=r.id.upper(), title="own title") for r in own if r.confidence >= 0.8]
    return s.createDataFrame([(r.id.lower(), r.title, r.enabled) for r in R.override(own, later)], "id string, title string, enabled boolean")


@query("SELECT 'warning' AS kind, lower(id) AS id FROM rules WHERE trim(id) <> '' AND confidence >= 0.8 AND (NOT coalesce(enabled, true) OR trim(match) <> '') UNION ALL SELECT 'error', min(lower(id)) FROM rules WHERE trim(id) <> '' AND (NOT coalesce(enabled, true) OR trim(match) <> '')")
def repeated_rule_ids(s, d):
    own = _pack(s, d)
    least = min(own, key=lambda r: r.id.lower())
    errors, warnings = R.duplicates([*own, least], [r for r in own if r.confidence >= 0.8])
    return s.createDataFrame([("error", i) for i in errors] + [("warning", i) for i in warnings], "kind string, id string")


@query(None)
def rule_problems(s, d):
    return s.createDataFrame([(r.id, p) for r in _pack(s, d) for p in R.lint(r)], "id string, problem string")


@query(f"WITH {_MATCHES}, k AS (SELECT id, list(score ORDER BY score DESC, rule_id) AS s FROM m GROUP BY id HAVING count(*) > 1) SELECT id, round(s[1] - s[2], 9) AS margin FROM k")
def match_margins(s, d):
    return pipeline.margins(R.match_rules(_logs(s, d), _pack(s, d))).select("id", F.round("margin", 9).alias("margin"))


@query(f"""SELECT id, array_to_string(list_transform(list_reverse_sort(list_filter([{_SCORES}], lambda x: x.score > 0))[:4], lambda x: x.ecosystem || ' ' || x.score), ', ') AS detail FROM analyses""")
def ecosystem_details(s, d):
    return _logs(s, d).select("id", F.array_join(F.transform(D.detail(F.col("text")), lambda x: F.concat(x["ecosystem"], F.lit(" "), x["score"].cast("string"))), ", ").alias("detail"))


@query(f"SELECT cluster, label, n, ecosystems, last_seen_us FROM ({log_queries.ORACLE['failure_clusters']}) WHERE n > 1 ORDER BY n DESC, last_seen_us DESC, cluster LIMIT 10")
def top_clusters(s, d):
    """The ten largest clusters of the incoming records."""
    x = V.cluster_summary(log_queries._clustered(log_queries._incoming(s, d)))
    return V.top_clusters(x).select("cluster", "label", "n", F.array_join("ecosystems", ",").alias("ecosystems"), F.unix_micros("last_seen").alias("last_seen_us"))


@query(f"""SELECT a.id, CASE WHEN f.head IS NOT NULL THEN 'resolved' ELSE a.status END AS status, CASE WHEN f.head IS NOT NULL THEN 'Likely fixed by ' || substr(f.head, 1, 7) || ' — auto-detected.' ELSE a.resolution END AS resolution,
    coalesce(f.head, a.resolved_commit) AS resolved_commit, CASE WHEN f.head IS NOT NULL THEN 'auto' ELSE a.resolution_source END AS resolution_source FROM analyses a LEFT JOIN ({history_queries.ORACLE['likely_fixed']}) f USING (id)""")
def reconciled_history(s, d):
    """Rows found fixed get resolution events, and these are applied to the history."""
    h = _h(s, d)
    found = history_queries.likely_fixed(s, d)
    ev = reconcile.resolution_events(found, NOW)
    return history.fold_resolutions(h, ev).select("id", "status", "resolution", "resolved_commit", "resolution_source")


@query(f"""WITH {_MATCHES}, k AS (SELECT id, count(*) AS n, first(rule_id ORDER BY score DESC, rule_id) AS rule_id, first(round_even(score, 4) ORDER BY score DESC, rule_id) AS score FROM m GROUP BY id)
    SELECT a.id, a.source, lower(a.ecosystem) AS ecosystem, k.id IS NOT NULL AS matched, k.rule_id AS root_cause, k.score AS confidence, coalesce(k.n, 0)::INT AS n FROM analyses a LEFT JOIN k USING (id)""")
def analysis_documents(s, d):
    """Every analysis as a JSON document, read back."""
    x = R.match_rules(_logs(s, d), _pack(s, d)).select("id", outputs.analysis_json().alias("j"))
    o = F.from_json("j", "source string, ecosystem string, matched boolean, rootCause struct<ruleId: string, confidence: double>, matches array<struct<ruleId: string>>")
    return x.select("id", o.alias("o")).select("id", "o.source", "o.ecosystem", "o.matched", F.col("o.rootCause.ruleId").alias("root_cause"), F.col("o.rootCause.confidence").alias("confidence"), F.size("o.matches").alias("n"))


def _issues(s, d) -> DataFrame:
    t = table(s, d, "rules").select(F.col("id").alias("rule_id"), "title", "fix", F.col("confidence").alias("score"), "severity")
    return _h(s, d).select("id", "source", "fingerprint", F.when(F.col("matched"), F.col("rule_id")).alias("rule_id")).join(F.broadcast(t), "rule_id", "left").withColumn("line_number", F.lit(None).cast("int"))  # a pack is small by contract


_ISSUE = """WITH x AS (SELECT a.id, a.source, a.fingerprint, CASE WHEN matched THEN a.rule_id END AS rule_id, r.title, r.fix, r.confidence AS score, lower(trim(r.severity)) AS severity FROM analyses a LEFT JOIN rules r ON r.id = a.rule_id AND a.matched),
    l AS (SELECT *, CASE WHEN rule_id IS NULL THEN NULL WHEN severity IN ('error', 'warning', 'note') THEN severity WHEN score >= 0.8 THEN 'error' WHEN score >= 0.6 THEN 'warning' ELSE 'note' END AS level,
        replace(split_part(source, '::', 1), chr(92), '/') AS path FROM x)"""


@query(f"""{_ISSUE} SELECT coalesce(rule_id, 'unmatched') AS check_name, fingerprint, CASE WHEN level = 'error' THEN 'major' WHEN level = 'warning' THEN 'minor' ELSE 'info' END AS severity, CASE WHEN trim(path) = '' THEN 'stdin' ELSE path END AS path, 1 AS line, count(*)::BIGINT AS n FROM l GROUP BY ALL""")
def quality_issues(s, d):
    o = F.from_json("issue", "checkName string, fingerprint string, severity string, location struct<path: string, lines: struct<begin: int>>")
    x = outputs.code_quality(_issues(s, d)).select(o.alias("o"))
    return x.groupBy(F.col("o.checkName").alias("check_name"), F.col("o.fingerprint").alias("fingerprint"), F.col("o.severity").alias("severity"), F.col("o.location.path").alias("path"), F.col("o.location.lines.begin").alias("line")).agg(F.count("*").alias("n"))


_ESC = "replace(replace(replace({}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
_PROP = f"replace(replace({_ESC}, ':', '%3A'), ',', '%2C')"


@query(f"""{_ISSUE} SELECT '::' || CASE WHEN rule_id IS NULL THEN 'notice' WHEN level = 'note' THEN 'notice' ELSE level END || ' file=' || {_PROP.format("CASE WHEN trim(path) = '' THEN 'stdin' ELSE path END")} || ',line=1,title=' || {_PROP.format("coalesce(title, 'Unknown failure')")} || '::' || {_ESC.format("coalesce(fix, '')")} AS command, count(*)::BIGINT AS n FROM l GROUP BY 1""")
def annotation_commands(s, d):
    return outputs.annotations(_issues(s, d)).groupBy("command").agg(F.count("*").alias("n"))


@query("SELECT id AS rule_id, CASE WHEN lower(severity) IN ('error', 'warning', 'note') THEN lower(severity) WHEN confidence >= 0.8 THEN 'error' WHEN confidence >= 0.6 THEN 'warning' ELSE 'note' END AS level FROM rules")
def sarif_rules(s, d):
    """The pack as results of a SARIF document, read back."""
    rows = [r.asDict() | {"rule_id": r.id, "score": r.confidence, "source": "x.log", "fingerprint": r.id} for r in table(s, d, "rules").collect()]
    run = json.loads(outputs.sarif(rows))["runs"][0]
    return s.createDataFrame([(run["tool"]["driver"]["rules"][x["ruleIndex"]]["id"], x["level"]) for x in run["results"]], "rule_id string, level string")


@query("SELECT CASE WHEN trim(coalesce(ecosystem, '')) = '' THEN 'unknown' ELSE ecosystem END AS ecosystem, count(*)::BIGINT AS n FROM analyses GROUP BY 1")
def metric_lines(s, d):
    """The lines by ecosystem of the metrics exposition, read back."""
    h = _h(s, d)
    text = outputs.prometheus(stats.totals(h).first().asDict(), [(r.ecosystem, r.n) for r in stats.by_ecosystem(h).collect()], [], 0.5, 0)
    rows = [(line.split('ecosystem="', 1)[1].rsplit('"}', 1)[0], int(line.rsplit(" ", 1)[1])) for line in text.splitlines() if "failures_by_ecosystem{" in line]
    return s.createDataFrame(rows, "ecosystem string, n long")


@query("SELECT count(*)::BIGINT AS total, (count(*) FILTER (status = 'resolved'))::BIGINT AS resolved, (count(*) FILTER (NOT matched))::BIGINT AS unmatched FROM analyses")
def statistics_document(s, d):
    o = json.loads(outputs.statistics_json(_h(s, d)))
    return s.createDataFrame([(o["total"], o["resolved"], o["unmatched"])], "total long, resolved long, unmatched long")


_TRX_NAMES = """SELECT DISTINCT source, name, classname, method, assembly, message, details FROM test_failures WHERE name IS NOT NULL"""


@query(rf"""
    WITH t AS ({_TRX_NAMES}), c AS (SELECT *, CASE WHEN method IS NOT NULL THEN nullif(trim(split_part(coalesce(classname, ''), ',', 1)), '') END AS cls FROM t)
    SELECT source || '.trx' AS source, CASE WHEN cls IS NOT NULL AND starts_with(name, cls || '.') THEN substr(name, length(cls) + 2) ELSE name END AS name, cls AS classname, method,
        regexp_replace(coalesce(message, ''), '^\s+|\s+$', '', 'g') AS message, nullif(regexp_replace(coalesce(details, ''), '^\s+|\s+$', '', 'g'), '') AS details,
        CASE WHEN method IS NOT NULL THEN nullif(regexp_replace(regexp_extract(trim(coalesce(assembly, '')), '([^/\\]*)$', 1), '(?i)\.(dll|exe)$', ''), '') END AS assembly FROM c
""")
def trx_failures(s, d):
    """Every failing test as a TRX document, whose definition is joined to its result by id."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit("&#10;"))
    t = table(s, d, "test_failures").where("name IS NOT NULL").select("source", "name", "classname", "method", "assembly", "message", "details").distinct()
    test = F.when(
        F.col("method").isNotNull(),
        F.concat(F.lit('<TestDefinitions><UnitTest id="A1"><TestMethod className="'), esc(F.col("classname")), F.lit('" name="'), esc(F.col("method")), F.lit('" codeBase="'), esc(F.col("assembly")), F.lit('"/></UnitTest></TestDefinitions>')),
    ).otherwise("")
    result = F.concat(F.lit('<Results><UnitTestResult testId="a1" outcome="Failed" testName="'), esc(F.col("name")), F.lit('"><Output><ErrorInfo><Message>'), esc(F.col("message")), F.lit("</Message><StackTrace>"), esc(F.col("details")), F.lit("</StackTrace></ErrorInfo></Output></UnitTestResult></Results>"))
    files = t.select(F.concat("source", F.lit(".trx")).alias("source"), F.concat(F.lit("<TestRun>"), test, result, F.lit("</TestRun>")).alias("content"))
    return reports.test_failures(spread(files)).select("source", "name", "classname", "method", "message", "details", "assembly")


@query("SELECT source, CASE WHEN coalesce(text, '') = '' THEN NULL ELSE text END AS text FROM (SELECT 'log ' || id AS source, excerpt AS text FROM analyses) WHERE text <> ''")
def log_units(s, d):
    """Raw logs as units: each is one, as it is."""
    files = _h(s, d).select(F.concat(F.lit("log "), F.col("id").cast("string")).alias("source"), F.col("excerpt").alias("content")).where("content <> ''")
    return reports.units(spread(files)).select("source", "text")


@query(f"WITH {_MATCHES}, b AS (SELECT id, max(score) AS score FROM m GROUP BY id) SELECT a.id, 'echo' AS model, length(right(trim(a.excerpt, ' '), 6000))::INT AS asked FROM analyses a LEFT JOIN b USING (id) WHERE b.score IS NULL OR b.score < 0.6")
def unsure_failures(s, d):
    """Failures a model would be asked about, with one that only measures what it is given."""
    x = assist.suggestions(R.match_rules(_logs(s, d), _pack(s, d)), lambda t: ("echo", str(len(t)), "none"))
    return x.select("id", "model", F.col("root_cause").cast("int").alias("asked"))


@query(None)
def hashed_embeddings(s, d):
    return assist.embeddings(_logs(s, d), assist.hashing_embedding).select("id", F.size("embedding").alias("size"))


@query("SELECT CASE WHEN matched THEN 'new-failure' ELSE 'resolved' END AS event, count(*)::BIGINT AS n FROM analyses WHERE matched GROUP BY 1")
def wanted_events(s, d):
    x = _h(s, d).select(F.when(F.col("matched"), "new-failure").otherwise("resolved").alias("event"))
    return events.only_events(x, {"NewFailure"}).groupBy("event").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM analyses WHERE NOT matched")
def undelivered_events(s, d):
    """A channel that fails for unmatched failures: what could not be sent is kept."""

    def send(e: dict) -> None:
        if not e["matched"]:
            raise ValueError("refused")

    stream = s.readStream.schema(_h(s, d).schema).parquet(f"{d}/analyses.parque[t]").select("id", "matched")
    return events.deliver(stream, send, Scratch(s)).agg(F.count("*").alias("n"))


@query(f"WITH {_MATCHES} SELECT count(DISTINCT id)::BIGINT AS n FROM m")
def explained_logs(s, d):
    """A pack with one rule that does not compile still explains the same logs."""
    bad = R.Rule("broken-rule", r"(?<open>[a-z", confidence=1.0)
    x = R.match_rules(_logs(s, d), [bad, *_pack(s, d)])
    return x.where(F.size("matches") > 0).agg(F.count("*").alias("n"))


@query(None)
def built_in_matches(s, d):
    """What the library's own packs find in all texts."""
    t = spread(table(s, d, "documents").select("doc_id", "ecosystem", "text"))
    m = R.match_rules(t, packs.built_in())
    return m.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.rule_id", "m.score")
