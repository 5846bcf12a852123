"""Queries over raw log text: normalising, tokenising, rules, detection, similarity, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions import text as X
from faultloom.operators import detect as D
from faultloom.operators import rules as R
from faultloom.operators import similarity as V
from faultloom.plans import pipeline
from faultloom.session import spread, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIPPED = rf"regexp_replace(regexp_replace(excerpt, {_q(X.ANSI)}, '', 'g'), '\r\n?', chr(10), 'g')"
_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, {_q(X.LINE_STAMP)}, '', 'g'), '(?m)[^\S\n]+$', '', 'g'), '\n+\z', '')"


def _scrub(text: str) -> str:
    t = f"regexp_replace({text}, {_q(X.ANSI)}, '', 'g')"
    t = f"regexp_replace({t}, {_q(X.WINDOWS_PATH)}, '<path>', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\w-])/(?:[^/\s:]+/)+[^/\s:]*', '\1<path>', 'g')"
    for p, to in ((X.GUID, "<guid>"), (X.HEX, "<hex>"), (X.NUMBER, "<n>")):
        t = f"regexp_replace({t}, {_q(p.removeprefix('(?U)'))}, '{to}', 'g')"
    return rf"regexp_replace(lower({t}), '^\s+|\s+$', '', 'g')"


def _a(s, d) -> DataFrame:
    return spread(table(s, d, "analyses"))


@query(f"SELECT id, {_NORMAL} AS normalized FROM analyses")
def normalize_logs(s, d):
    return _a(s, d).select("id", X.normalize("excerpt").alias("normalized"))


@query(f"SELECT id, {_scrub('excerpt')} AS scrubbed FROM analyses")
def scrub_logs(s, d):
    return _a(s, d).select("id", X.scrub("excerpt").alias("scrubbed"))


TERMS_SQL = f"SELECT id, term, count(*)::INT AS n FROM (SELECT id, unnest(regexp_extract_all({_scrub(_NORMAL)}, {_q(X.TERM)})) AS term FROM analyses) WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1, 2"


@query(TERMS_SQL)
def tokenize_terms(s, d):
    return _a(s, d).select("id", F.explode(X.term_counts(X.normalize("excerpt"))).alias("term", "n"))


@query("SELECT id, unnest(map_keys(tokens)) AS term FROM analyses WHERE tokens IS NOT NULL")
def stored_terms(s, d):
    """The stored bags equal what the tokenizer yields now."""
    return _a(s, d).where("tokens IS NOT NULL").select("id", F.explode(F.map_keys(X.term_counts(X.normalize("excerpt")))).alias("term"))


_BAD = "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), 'error|fail|exception'))"
_FULL = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S'))"
_ERRORS = f"CASE WHEN len({_BAD}) > 0 THEN list_slice({_BAD}, 1, 5) ELSE list_slice({_FULL}, -5, -1) END"


@query(f"SELECT id, array_to_string({_ERRORS}, chr(10)) AS lines FROM (SELECT id, {_NORMAL} AS t FROM analyses)")
def error_like_lines(s, d):
    return _a(s, d).select("id", F.array_join(X.error_like_lines(X.normalize("excerpt")), "\n").alias("lines"))


@query(f"SELECT id, rule_id || ':' || substr(sha256(rule_id || chr(10) || {_scrub('sig')}), 1, 12) AS fingerprint, sha256(excerpt) AS log_hash FROM (SELECT id, rule_id, excerpt, array_to_string({_ERRORS}, chr(10)) AS sig FROM (SELECT id, rule_id, excerpt, {_NORMAL} AS t FROM analyses))")
def fingerprint_logs(s, d):
    sig = F.array_join(X.error_like_lines(X.normalize("excerpt")), "\n")
    return _a(s, d).select("id", X.fingerprint("rule_id", sig).alias("fingerprint"), X.log_hash("excerpt").alias("log_hash"))


@query(r"SELECT doc_id, right(regexp_replace(text, '^\s+|\s+$', '', 'g'), 6000) AS tail FROM documents WHERE text IS NOT NULL")
def tail_excerpts(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.tail_excerpt("text").alias("tail"))


def _pack(s, d) -> list[R.Rule]:
    return R.rules_from(table(s, d, "rules"))


_MATCHES = """
    r AS (SELECT *, replace(match, '(?<', '(?P<') AS pattern, list_transform(list_concat(CASE WHEN ecosystem IS NOT NULL THEN [ecosystem] WHEN len(coalesce(ecosystems, [])) > 0 THEN [] ELSE ['generic'] END, coalesce(ecosystems, [])), lambda x: lower(x)) AS declared
        FROM rules WHERE coalesce(enabled, true) AND trim(id) <> '' AND trim(match) <> ''),
    l AS (SELECT id, excerpt, rule_id AS stored, lower(trim(coalesce(ecosystem, 'unknown'))) AS eco FROM analyses),
    m AS (SELECT l.id, l.stored, l.excerpt, r.id AS rule_id, coalesce(r.confidence, 0.5) AS score, r.pattern, r.severity FROM l JOIN r ON (list_contains(declared, 'generic') OR eco IN ('generic', 'unknown', '') OR list_contains(declared, eco) OR (eco IN ('android', 'scala') AND list_contains(declared, 'java')))
        AND regexp_matches(excerpt, pattern, 'im')
        AND (requires IS NULL OR trim(requires) = '' OR regexp_matches(excerpt, requires, 'im')) AND (not_match IS NULL OR trim(not_match) = '' OR NOT regexp_matches(excerpt, not_match, 'im')))
"""


@query(f"WITH {_MATCHES} SELECT id, rule_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, rule_id)::INT AS rank FROM m")
def rule_matches(s, d):
    m = R.match_rules(_a(s, d).select("id", "ecosystem", F.col("excerpt").alias("text")), _pack(s, d))
    return m.select("id", F.posexplode("matches").alias("pos", "m")).select("id", "m.rule_id", "m.score", (F.col("pos") + 1).alias("rank"))


@query(f"WITH {_MATCHES} SELECT l.id, coalesce(first(m.rule_id ORDER BY score DESC, m.rule_id), 'unknown') AS root_cause, count(m.rule_id)::BIGINT AS n_matches FROM l LEFT JOIN m USING (id) GROUP BY 1")
def root_cause(s, d):
    m = R.match_rules(_a(s, d).select("id", "ecosystem", F.col("excerpt").alias("text")), _pack(s, d))
    return m.select("id", F.coalesce(F.try_element_at("matches", F.lit(1))["rule_id"], F.lit("unknown")).alias("root_cause"), F.size("matches").cast("long").alias("n_matches"))


@query(f"""WITH {_MATCHES} SELECT id, rule_id,
        CASE WHEN instr(pattern, '<subject>') < instr(pattern, '<peer>') OR instr(pattern, '<peer>') = 0 THEN regexp_extract(excerpt, '(?im)' || pattern, 1) ELSE regexp_extract(excerpt, '(?im)' || pattern, 2) END AS subject,
        len(string_split(left(excerpt, instr(excerpt, regexp_extract(excerpt, '(?im)' || pattern))), chr(10)))::INT AS line_number, len(regexp_extract_all(excerpt, '(?im)' || pattern))::INT AS occurrences FROM m""")
def match_evidence(s, d):
    m = R.match_rules(_a(s, d).select("id", "ecosystem", F.col("excerpt").alias("text")), _pack(s, d))
    return R.with_evidence(m).select("id", "rule_id", F.col("captures")["subject"].alias("subject"), "line_number", "occurrences")


@query("SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, CASE WHEN severity IN ('error', 'warning', 'note') THEN severity WHEN confidence >= 0.8 THEN 'error' WHEN confidence >= 0.6 THEN 'warning' ELSE 'note' END AS level FROM rules")
def rule_levels(s, d):
    return table(s, d, "rules").select("id", X.confidence_bucket("confidence").alias("bucket"), X.sarif_level("confidence", "severity").alias("level"))


def _marker(p: str) -> str:
    return f"regexp_matches(excerpt, {_q('(?im)' + p)})"


_SCORES = ", ".join(f"{{'score': {' + '.join(f'CASE WHEN {_marker(p)} THEN {w} ELSE 0 END' for p, w in D.weighted(n))}, 'precedence': {-i}, 'ecosystem': '{n}'}}" for i, n in enumerate(D.PRECEDENCE))


@query(f"SELECT id, CASE WHEN best.score >= 2 THEN best.ecosystem ELSE 'generic' END AS detected, best.score::INT AS score FROM (SELECT id, list_max([{_SCORES}]) AS best FROM analyses)")
def detect_ecosystem(s, d):
    return _a(s, d).select("id", D.best(F.col("excerpt")).alias("b")).select("id", D.claimed(F.col("b")).alias("detected"), F.col("b.score").alias("score"))


_ANALYZED = f"""
    raw AS (SELECT id, excerpt AS raw, {_NORMAL} AS excerpt FROM analyses),
    l AS (SELECT id, raw, excerpt, CASE WHEN best.score >= 2 THEN best.ecosystem ELSE 'generic' END AS eco FROM (SELECT *, list_max([{_SCORES}]) AS best FROM raw)),
    @RULES@,
    root AS (SELECT id, first(rule_id ORDER BY score DESC, rule_id) AS rule_id, first(pattern ORDER BY score DESC, rule_id) AS pattern FROM m GROUP BY id),
    x AS (SELECT l.*, root.rule_id, string_split(excerpt, chr(10)) AS ls, len(string_split(left(excerpt, instr(excerpt, regexp_extract(excerpt, '(?im)' || pattern))), chr(10))) AS n FROM l LEFT JOIN root USING (id))
""".replace("@RULES@", _MATCHES.replace("l AS (SELECT id, excerpt, rule_id AS stored, lower(trim(coalesce(ecosystem, 'unknown'))) AS eco FROM analyses),", "").replace("l.id, l.stored,", "l.id,").strip())


@query(f"""WITH {_ANALYZED} SELECT id, eco AS ecosystem, coalesce(rule_id, 'unknown') AS rule_id, rule_id IS NOT NULL AS matched, sha256(raw) AS log_hash,
        coalesce(rule_id, 'unknown') || ':' || substr(sha256(coalesce(rule_id, 'unknown') || chr(10) || {_scrub('CASE WHEN rule_id IS NOT NULL THEN ls[n] ELSE array_to_string(' + _ERRORS.replace('t, chr(10)', 'excerpt, chr(10)') + ', chr(10)) END')}), 1, 12) AS fingerprint
    FROM x""")
def analyze_logs(s, d):
    """The whole analysis of every stored log, as if it came in now."""
    logs = _a(s, d).select("id", F.col("excerpt").alias("text"))
    return pipeline.analyze(logs, _pack(s, d)).select("id", "ecosystem", "rule_id", "matched", "log_hash", "fingerprint")


def _filled(df: DataFrame) -> DataFrame:
    """Null ``tokens`` replaced by the terms of the normalised excerpt; a row without either has none."""
    return df.withColumn("tokens", F.coalesce("tokens", X.term_counts(X.normalize("excerpt")), F.create_map().cast("map<string,int>")))


def _bags(table_name: str, key: str, n: str) -> str:
    """Terms of every row, as :func:`_filled`, and their idf over ``n`` rows."""
    src = f"(SELECT {key} AS id, tokens, excerpt FROM {table_name})"
    derived = TERMS_SQL.replace("FROM analyses", f"FROM {src} WHERE tokens IS NULL")
    return f"""t AS (SELECT id, e.key AS term, e.value AS tf FROM (SELECT id, unnest(map_entries(tokens)) AS e FROM {src} WHERE tokens IS NOT NULL) UNION ALL SELECT id, term, n AS tf FROM ({derived})),
    n AS (SELECT {n}::DOUBLE AS n FROM {table_name}), i AS (SELECT term, count(*)::BIGINT AS df, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY term)"""


_BAGS = _bags("analyses", "id", "count(*)")


@query(f"WITH {_BAGS} SELECT term, df, round_even(idf, 6) AS idf FROM i")
def idf_terms(s, d):
    a = _filled(_a(s, d))
    return V.idf(V.term_rows(a, "id", F.col("tokens")), F.lit(a.count())).select("term", "df", F.bround("idf", 6).alias("idf"))


_W = "w AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM t JOIN i USING (term))"


@query(f"""WITH {_BAGS}, {_W},
    s AS (SELECT a.id AS query_id, b.id, round(sum(a.w * b.w), 12) AS score FROM w a JOIN w b USING (term) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0)
    SELECT query_id, id, round_even(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 3""")
def tfidf_top(s, d):
    a = _filled(_a(s, d)).select("id", F.col("tokens").alias("terms"))
    return V.tfidf_top(a.where("id % 20 = 0"), a).select("query_id", "id", F.bround("score", 4).alias("score"), "rank")


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT query_id, id, round_even(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 3""")
def vector_top(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.vector_top(e.where("id % 20 = 0"), e).select("query_id", "id", F.bround("score", 4).alias("score"), "rank")


def _incoming(s, d) -> DataFrame:
    return _filled(table(s, d, "incoming")).withColumnRenamed("record_id", "id")


_PAIRS = f"""WITH RECURSIVE {_bags('incoming', 'record_id', '(SELECT count(DISTINCT id) FROM t)').replace("::DOUBLE AS n FROM incoming", "::DOUBLE AS n")}, {_W},
    p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM w a JOIN w b USING (term) WHERE a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.5 - 1e-12)"""


@query(f"{_PAIRS} SELECT a, b, round_even(cosine, 4) AS cosine FROM p")
def cosine_pairs(s, d):
    return V.cosine_pairs(V.term_bags(_incoming(s, d), "id", F.col("tokens")), 0.5).select("a", "b", F.bround("cosine", 4).alias("cosine"))


_CLUSTERS = f"""{_PAIRS}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
    c AS (SELECT record_id AS id, record_id AS root FROM incoming UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id), k AS (SELECT id, min(root) AS cluster FROM c GROUP BY 1),
    x AS (SELECT cluster, id, rule_id, matched, CASE WHEN trim(coalesce(ecosystem, '')) = '' THEN 'unknown' ELSE ecosystem END AS eco, analyzed_at FROM k JOIN incoming ON record_id = id),
    v AS (SELECT cluster, rule_id, count(*) AS n FROM x WHERE matched GROUP BY 1, 2)"""


def _clustered(x: DataFrame) -> DataFrame:
    return V.cluster_members(x.select("id", "rule_id", "matched", "ecosystem", "analyzed_at"), V.term_bags(x, "id", F.col("tokens")))


@query(f"{_CLUSTERS} SELECT id, cluster FROM x")
def cluster_members(s, d):
    return _clustered(_incoming(s, d)).select("id", "cluster")


@query(f"""{_CLUSTERS} SELECT cluster, coalesce((SELECT first(rule_id ORDER BY n DESC, rule_id) FROM v WHERE v.cluster = x.cluster), 'unmatched') AS label, count(*)::BIGINT AS n,
        array_to_string(list_sort(list(DISTINCT eco)), ',') AS ecosystems, epoch_us(max(analyzed_at)) AS last_seen_us FROM x GROUP BY cluster""")
def failure_clusters(s, d):
    return V.cluster_summary(_clustered(_incoming(s, d))).select("cluster", "label", "n", F.array_join("ecosystems", ",").alias("ecosystems"), F.unix_micros("last_seen").alias("last_seen_us"))


@query(None)
def history_pairs(s, d):
    """``cosine_pairs`` over the whole history."""
    return V.cosine_pairs(V.term_bags(_filled(_a(s, d)), "id", F.col("tokens")), 0.5).select("a", "b", F.bround("cosine", 4).alias("cosine"))


@query(None)
def history_cluster_members(s, d):
    """``cluster_members`` over the whole history."""
    return _clustered(_filled(_a(s, d))).select("id", "cluster")


@query(None)
def history_clusters(s, d):
    """``failure_clusters`` over the whole history."""
    return V.cluster_summary(_clustered(_filled(_a(s, d)))).select("cluster", "label", "n", F.array_join("ecosystems", ",").alias("ecosystems"), F.unix_micros("last_seen").alias("last_seen_us"))
