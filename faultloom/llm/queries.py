"""Queries of the problems tagged llm, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm.components import match_groups
from faultloom.llm.heavy_hitters import frequent_items
from faultloom.llm.history_dedup import refused_by_batches, refused_records
from faultloom.llm.leakage import leaked_spans
from faultloom.llm.neardup import similar_groups, similar_pairs
from faultloom.functions.text import row_terms
from faultloom.llm.packing import VOCABULARY, Limits, packed_containers
from faultloom.llm.sentences import sentence_units
from faultloom.plans.log_queries import TERMS_SQL
from faultloom.session import Scratch, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(table(spark, sf_dir, "analyses"), "fingerprint", 0.01).select(F.col("item").alias("fingerprint"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same survivors with their counts."""
    return frequent_items(table(spark, sf_dir, "analyses"), "fingerprint", 0.01).select(F.col("item").alias("fingerprint"), "n_rows")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(table(spark, sf_dir, "analyses"), table(spark, sf_dir, "match_pairs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "analyses"), row_terms())


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "analyses"), row_terms())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused_records(table(spark, sf_dir, "analyses"), table(spark, sf_dir, "incoming"), row_terms(), row_terms())


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p5_found``, five batches at a time through segments on storage."""
    return refused_by_batches(table(spark, sf_dir, "analyses"), table(spark, sf_dir, "incoming"), row_terms(), row_terms(), f"{Scratch(spark).root}/accepted", together=5)


def p7_containers(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY, limits: Limits = Limits()) -> DataFrame:
    return packed_containers(table(spark, sf_dir, "documents"), limits=limits, vocabulary=vocabulary)


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of instruction data, of which at most 1600 tokens bear loss, by what closed them."""
    x = p7_containers(spark, sf_dir, limits=Limits(2048, 24, 1600)).groupBy("container_id").agg(F.max("closed_by").alias("closed_by"), F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("x"), F.count("*").alias("s"))
    return x.groupBy("closed_by").agg(F.count("*").alias("n_containers"), F.sum("s").alias("n_segments"), F.sum("t").alias("n_tokens"), F.sum("x").alias("n_loss"))


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every text in its place once, no limit broken, no early cut."""
    lim, rows = Limits(), Scratch(spark).save(p7_containers(spark, sf_dir))
    full = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"), F.sum("n_loss").alias("x"), F.count_distinct("segment_no").alias("d"))
    broken = F.count_if((F.col("t") > lim.tokens) | (F.col("s") > lim.segments) | (F.col("x") > lim.loss) | (F.col("d") != F.col("s")))
    texts = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"), F.max("end_char").alias("e"), F.count("*").alias("s"), F.sum("n_tokens").alias("t"), F.count_distinct("start_char").alias("d"))
    bad = F.count_if((F.col("n") != F.col("e")) | (F.col("d") != F.col("s")) | (F.col("s") > 1) & (F.col("t") <= lim.tokens))
    one = texts.agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_chars"), bad.alias("n_bad_texts"))
    return one.join(full.agg(broken.alias("n_broken")), F.lit(True))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest leaked passage of every affected document and item, and where it lies."""
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_batches": p5_batches, "p7_containers": p7_containers, "p7_limits": p7_limits, "p7_cover": p7_cover, "p8_found": p8_found, "p8_spans": p8_spans, "p9_found": p9_found}
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_FREQUENT = """
    SELECT fingerprint, count(*)::BIGINT AS n_rows FROM analyses WHERE fingerprint IS NOT NULL
    GROUP BY fingerprint HAVING count(*) * 100 >= (SELECT count(*) FROM analyses)
"""
_PAIRS = f"""
        WITH t AS (
            SELECT id, unnest(map_keys(tokens)) AS term FROM analyses WHERE tokens IS NOT NULL
            UNION ALL SELECT id, term FROM ({TERMS_SQL}) WHERE id IN (SELECT id FROM analyses WHERE tokens IS NULL)
        ), n AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
        s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS i FROM t a JOIN t b USING (term) WHERE a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE i * 10 >= 7 * (x.n + y.n - i)
"""
_INCOMING_TERMS = TERMS_SQL.replace("FROM analyses", "FROM (SELECT record_id AS id, excerpt FROM incoming)")
# in order of batch and record, with all that is accepted so far in one list
_REFUSED = rf"""
    WITH RECURSIVE old AS (
        SELECT fingerprint, analyzed_at, coalesce(map_keys(tokens), x.terms, []) AS terms FROM analyses
        LEFT JOIN (SELECT id, list(term) AS terms FROM ({TERMS_SQL}) GROUP BY 1) x USING (id) WHERE analyzed_at IS NOT NULL
    ), new AS (
        SELECT record_id, row_number() OVER (ORDER BY batch_no, record_id) AS k, fingerprint, analyzed_at, coalesce(map_keys(tokens), x.terms, []) AS terms FROM incoming
        LEFT JOIN (SELECT id, list(term) AS terms FROM ({_INCOMING_TERMS}) GROUP BY 1) x ON x.id = record_id WHERE analyzed_at IS NOT NULL
    ), hist AS (
        SELECT DISTINCT k FROM new n JOIN old o ON o.fingerprint = n.fingerprint AND date_trunc('second', o.analyzed_at) = date_trunc('second', n.analyzed_at)
        UNION SELECT DISTINCT k FROM new n JOIN old o ON o.analyzed_at BETWEEN n.analyzed_at - INTERVAL 15 MINUTE AND n.analyzed_at + INTERVAL 15 MINUTE
        WHERE len(n.terms) > 0 AND len(o.terms) > 0 AND len(list_intersect(n.terms, o.terms)) * 10 >= 7 * (len(n.terms) + len(o.terms) - len(list_intersect(n.terms, o.terms)))
    ), e AS (
        SELECT n.k, o.k AS before FROM new n JOIN new o ON o.k < n.k AND o.fingerprint = n.fingerprint AND date_trunc('second', o.analyzed_at) = date_trunc('second', n.analyzed_at)
        UNION SELECT n.k, o.k FROM new n JOIN new o ON o.k < n.k AND o.analyzed_at BETWEEN n.analyzed_at - INTERVAL 15 MINUTE AND n.analyzed_at + INTERVAL 15 MINUTE
        WHERE len(n.terms) > 0 AND len(o.terms) > 0 AND len(list_intersect(n.terms, o.terms)) * 10 >= 7 * (len(n.terms) + len(o.terms) - len(list_intersect(n.terms, o.terms)))
    ), w AS (SELECT new.k, record_id, hist.k IS NOT NULL AS known, b.befores FROM new LEFT JOIN hist USING (k) LEFT JOIN (SELECT k, list(before) AS befores FROM e GROUP BY 1) b USING (k)),
    s AS (
        SELECT 0::BIGINT AS k, []::BIGINT[] AS accepted
        UNION ALL SELECT s.k + 1, CASE WHEN w.known OR coalesce(list_has_any(w.befores, s.accepted), false) THEN s.accepted ELSE list_append(s.accepted, s.k + 1) END FROM s JOIN w ON w.k = s.k + 1
    )
    SELECT record_id FROM w, (SELECT accepted FROM s ORDER BY k DESC LIMIT 1) f WHERE NOT list_contains(f.accepted, w.k)
"""
ORACLE: dict[str, str] = {
    "p2_found": f"SELECT fingerprint FROM ({_FREQUENT})",
    "p2_counts": _FREQUENT,
    "p3_found": f"""
        WITH RECURSIVE q AS (
            SELECT {_TRIM.format('left_ref')} AS l, {_TRIM.format('right_ref')} AS r FROM match_pairs WHERE lower({_TRIM.format('verdict')}) = 'match'
        ), p AS (SELECT l, r FROM q WHERE l <> '' AND r <> ''), ref AS (SELECT l AS ref FROM p UNION SELECT r FROM p),
        o AS (SELECT id::VARCHAR AS l, fingerprint AS r FROM analyses WHERE id::VARCHAR IN (SELECT ref FROM ref) AND fingerprint IN (SELECT ref FROM ref)),
        e AS (SELECT l AS a, r AS b FROM p UNION SELECT r, l FROM p UNION SELECT l, r FROM o UNION SELECT r, l FROM o),
        c AS (SELECT ref AS node, ref AS root FROM ref UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
        k AS (SELECT node, min(root) AS comp FROM c GROUP BY node),
        x AS (SELECT a.id, coalesce(f.comp, i.comp) AS comp FROM analyses a LEFT JOIN k f ON f.node = a.fingerprint LEFT JOIN k i ON i.node = a.id::VARCHAR)
        SELECT id, min(id) OVER (PARTITION BY comp) AS group_id FROM x WHERE comp IS NOT NULL QUALIFY count(*) OVER (PARTITION BY comp) > 1
    """,
    "p4_found": _PAIRS,
    "p4_groups": f"""
        WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT id_a AS a, id_b AS b FROM p UNION ALL SELECT id_b, id_a FROM p),
        c AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
        g AS (SELECT id, min(root) AS group_id FROM c GROUP BY 1), l AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1),
        r AS (SELECT id FROM analyses WHERE cardinality(tokens) > 0 UNION SELECT id FROM ({TERMS_SQL}) WHERE id IN (SELECT id FROM analyses WHERE tokens IS NULL))
        SELECT r.id, coalesce(g.group_id, r.id) AS group_id, coalesce(l.n, 0)::BIGINT AS n_links FROM r LEFT JOIN g USING (id) LEFT JOIN l USING (id)
    """,
    "p5_found": _REFUSED,
    "p5_batches": _REFUSED,
    "p7_cover": "SELECT count(*)::BIGINT AS n_texts, sum(length(text))::BIGINT AS n_chars, 0::BIGINT AS n_bad_texts, 0::BIGINT AS n_broken FROM documents WHERE text <> ''",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k + 11], ' '))) AS gram FROM d WHERE len(w) >= 12),
        ig AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k + 11], ' '))) AS gram FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)
    """,
    "p8_spans": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, unnest(generate_series(1, len(w) - 11)) AS p, array_to_string(w[p:p + 11], ' ') AS gram FROM d WHERE len(w) >= 12),
        ig AS (SELECT item_id, unnest(generate_series(1, len(w) - 11)) AS q, array_to_string(w[q:q + 11], ' ') AS gram FROM i WHERE len(w) >= 12),
        m AS (SELECT doc_id, item_id, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM dg JOIN ig USING (gram)),
        r AS (SELECT doc_id, item_id, min(p) AS p, min(q) AS q, count(*) + 11 AS n FROM m GROUP BY doc_id, item_id, p - q, run)
        SELECT doc_id, item_id, n::INT AS n_words, (p - 1)::INT AS doc_word, (q - 1)::INT AS item_word FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, p, q) = 1
    """,
}
