"""TF-IDF and vector similarity; clusters of similar failures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from faultloom.operators import cosine_join
from faultloom.operators.components import contract, min_label_components
from faultloom.session import Scratch, spread

BLOCK_QUERIES = 2048
FREQUENT = 1 << 18  # terms sent to every task


def term_rows(df: DataFrame, row_id: str, terms: Column) -> DataFrame:
    """``(id, term, tf)`` of a ``map<string,int>`` column."""
    return df.select(F.col(row_id).alias("id"), F.explode(terms).alias("term", "tf"))


def idf(rows: DataFrame, n: Column) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1+n)/(1+df)) + 1."""
    return rows.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(rows: DataFrame, idfs: DataFrame) -> DataFrame:
    """``(id, term, w)``: unit vectors of tf * idf."""
    w = rows.join(idfs, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").where("norm > 0").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def term_bags(df: DataFrame, row_id: str, terms: Column) -> DataFrame:
    """``(id, e)`` of a ``map<string,int>`` column, e an array of ``(term, tf)``; like
    :func:`term_rows`, but nothing is shuffled unless ids repeat."""
    if df.groupBy(row_id).count().where("count > 1").limit(1).count():
        return _bags(term_rows(df, row_id, terms))
    return df.select(F.col(row_id).alias("id"), F.map_entries(terms).cast("array<struct<term: string, tf: int>>").alias("e"))


def _bags(rows: DataFrame) -> DataFrame:
    return rows if "e" in rows.columns else rows.groupBy("id").agg(F.collect_list(F.struct(F.col("term").cast("string").alias("term"), F.col("tf").cast("int").alias("tf"))).alias("e"))


def _numbers(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(term, df, number)``, numbers from 0 by falling df."""
    placed = scratch.save(counts.orderBy(F.desc("df"), "term").withColumn("m", F.monotonically_increasing_id()))
    sizes = {r.p: r["count"] for r in placed.groupBy(F.shiftright("m", 33).alias("p")).count().collect()}
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    at = F.get(F.lit(before), F.shiftright("m", 33).cast("int"))
    return placed.select("term", "df", (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + at).alias("number"))


def packed_vectors(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, cosine_join.Idf]:
    """``(id, norm, v, own)`` for each id with terms, v its shared terms and their counts, packed, own
    whether it has others; and the idf of these terms. The ``FREQUENT`` most frequent terms are numbered where rows are read,
    others by a join."""
    bags = _bags(rows).where("size(e) > 0")
    seen = Observation()
    counts = bags.observe(seen, F.count("id").alias("n")).select(F.explode("e.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    numbers = _numbers(counts, scratch)
    idfs = cosine_join.Idf(seen.get["n"], [(r.df, r["count"]) for r in numbers.groupBy("df").count().collect()])
    often = numbers.where(F.col("number") < FREQUENT).select("number", "term").toArrow().sort_by("number").column("term").combine_chunks()
    mine = bags.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "e")
    x = spread(mine).mapInArrow(cosine_join.numbered(often), "id long, term array<int>, tf array<int>, rare array<struct<term: string, tf: int>>")
    if len(often) < FREQUENT:
        single = F.aggregate(F.transform("rare", lambda r: r["tf"].cast("double") * r["tf"]), F.lit(0.0), lambda s, r: s + r)
        x = x.select("id", "term", "tf", F.expr("cast(array() as array<struct<number: int, tf: int>>)").alias("more"), single.alias("single"))
    else:
        x = scratch.save(x)
        rest = numbers.where(F.col("number") >= FREQUENT).select("term", F.col("number").cast("int").alias("number"))
        rare = x.select("id", F.explode("rare").alias("r")).select("id", "r.term", "r.tf").join(rest, "term", "left")
        square = F.sum(F.when(F.col("number").isNull(), F.col("tf").cast("double") * F.col("tf")))
        more = rare.groupBy("id").agg(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "tf"))).alias("more"), square.alias("single"))
        x = x.drop("rare").join(more, "id", "left")
    return x.mapInArrow(cosine_join.packed(idfs), cosine_join.VECTORS), idfs


def _compared(vectors: DataFrame, idfs: cosine_join.Idf, threshold: float) -> DataFrame:
    index = vectors.select("id", "norm", "v").mapInArrow(cosine_join.entries(idfs, threshold), cosine_join.ENTRIES)
    return index.repartition("term").sortWithinPartitions("term").mapInArrow(cosine_join.compare(idfs, threshold), cosine_join.PAIRS)


def cosine_pairs(rows: DataFrame, threshold: float, scratch: Scratch | None = None) -> DataFrame:
    """``(a, b, cosine)`` with a < b: all pairs of vectors at ``threshold`` or above.

    ``rows`` are those of :func:`term_rows` or :func:`term_bags`. A vector is indexed by its rarest
    terms only, up to where the rest has a norm below the threshold: two vectors that share none of
    these cannot reach it. An entry carries its vector packed, so pairs are computed where entries
    meet (:mod:`cosine_join`): what is shuffled follows the rows, not the pairs. Terms in one row
    are never indexed.
    """
    return _compared(*packed_vectors(rows, scratch or Scratch(rows.sparkSession)), threshold)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy()
    return np.repeat(np.arange(len(col)), np.diff(off)), col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]


def cluster_members(meta: DataFrame, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``meta`` with ``cluster``, the smallest id of its single-link cluster; rows that resemble no
    other are clusters of their own. Of copies the first is compared and the others follow it."""
    scratch = Scratch(meta.sparkSession)
    vectors, idfs = packed_vectors(rows, scratch)
    text = lambda c: F.encode(F.col(c).cast("string"), "utf-8")
    # terms of one row alone are not packed; a row that has any is no copy
    vectors = scratch.save(vectors.withColumn("bag", F.when(F.col("own"), text("id")).otherwise(F.unhex(F.sha2(F.concat("v", text("norm")), 256)))))
    chosen = scratch.save(vectors.groupBy("bag").agg(F.min("id").alias("id"), F.first("norm").alias("norm"), F.first("v").alias("v")))
    first = vectors.select("id", "bag").join(chosen.select("bag", F.col("id").alias("first")), "bag").select("id", "first")
    pairs = contract(_compared(chosen, idfs, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    comp = min_label_components(pairs, scratch).withColumnRenamed("vertex", "first")
    own = first.join(comp, "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    return scratch.save(meta.join(own, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component"))


def cluster_summary(members: DataFrame) -> DataFrame:
    """``(cluster, label, n, ecosystems, last_seen)`` of members ``(id, cluster, rule_id, matched,
    ecosystem, analyzed_at)``; the label is the most frequent rule of matched members."""
    votes = members.where("matched").groupBy("cluster", "rule_id").count().groupBy("cluster").agg(F.min_by("rule_id", F.struct(-F.col("count"), "rule_id")).alias("label"))
    eco = F.when(F.coalesce(F.trim("ecosystem"), F.lit("")) == "", "unknown").otherwise(F.col("ecosystem"))
    out = members.groupBy("cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(eco)).alias("ecosystems"), F.max("analyzed_at").alias("last_seen"))
    return out.join(votes, "cluster", "left").select("cluster", F.coalesce("label", F.lit("unmatched")).alias("label"), "n", "ecosystems", "last_seen")


def top_clusters(summary: DataFrame, top: int = 10, singletons: bool = False) -> DataFrame:
    """Largest clusters first; 0 means all."""
    x = summary if singletons else summary.where("n > 1")
    x = x.orderBy(F.desc("n"), F.desc("last_seen"), "cluster")
    return x.limit(top) if top > 0 else x


def _merge_top(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> Iterator[tuple[int, int, float]]:
    """Best k columns of each row, higher score then higher id first."""
    for q in range(scores.shape[0]):
        row = scores[q]
        cand = np.flatnonzero(row > floor)
        if len(cand) > k:
            edge = np.partition(row[cand], len(cand) - k)[len(cand) - k]
            cand = cand[row[cand] >= edge]
        for c in sorted(cand, key=lambda c: (-row[c], -ids[c]))[:k]:
            yield q, int(ids[c]), float(row[c])


class _Block:
    """An inverted index over a block of query vectors, for products with batches of the corpus.

    Terms in more than a sixteenth of the queries, at most sixteen times as many as a query has,
    are columns of a dense matrix; the others have postings.
    """

    def __init__(self, rows: list):
        self.ids = np.array([r.id for r in rows], np.int64)
        t = np.array([x for r in rows for x in r.t], np.int64)
        w = np.array([x for r in rows for x in r.w], np.float64)
        q = np.repeat(np.arange(len(rows)), [len(r.t) for r in rows])
        self.terms, slot = np.unique(t, return_inverse=True)
        order = np.argsort(slot, kind="stable")
        self.q, self.w = q[order], w[order]
        self.at = np.append(0, np.cumsum(np.bincount(slot, minlength=len(self.terms))))
        often = np.diff(self.at) * 16 > len(rows)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), len(rows)))
        hit = self.column[slot] >= 0
        self.dense[self.column[slot[hit]], q[hit]] = w[hit]
        self.order = np.argsort(self.ids)

    def scores(self, ids: np.ndarray, row: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """``(rows, queries)`` products; a row with itself has none."""
        n, m = len(ids), len(self.ids)
        slot = np.minimum(np.searchsorted(self.terms, t), max(len(self.terms) - 1, 0))
        known = self.terms[slot] == t if len(self.terms) else np.zeros(len(t), bool)
        row, slot, w = row[known], slot[known], w[known]
        col = self.column[slot]
        x = np.zeros((n, len(self.dense)))
        x[row[col >= 0], col[col >= 0]] = w[col >= 0]
        out = x @ self.dense
        row, slot, w = row[col < 0], slot[col < 0], w[col < 0]
        many = self.at[slot + 1] - self.at[slot]
        post = np.repeat(self.at[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out += np.bincount(np.repeat(row, many) * m + self.q[post], np.repeat(w, many) * self.w[post], n * m).reshape(n, m)
        place = np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), m - 1)
        same = self.ids[self.order[place]] == ids
        out[np.flatnonzero(same), self.order[place[same]]] = 0.0
        return np.round(out, 12)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query: higher scores, then higher ids."""
    o = np.lexsort((-ids, -score, q))
    q, ids, score = q[o], ids[o], score[o]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], ids[keep], score[keep]


def _top_of_block(block: _Block, k: int, rows_at_once: int = 2000):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = np.zeros(len(block.ids))  # the k-th best score of each query so far
        for b in batches:
            for start in range(0, b.num_rows, rows_at_once):
                part = b.slice(start, rows_at_once)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                (row, t), (_, w) = _flat(part.column(1)), _flat(part.column(2))
                s = block.scores(ids, row, t, w)
                edge = np.partition(s, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.zeros(s.shape[1])
                r, q = np.nonzero((s >= np.maximum(edge, floor)) & (s > 0))
                best = _best(np.append(best[0], q), np.append(best[1], ids[r]), np.append(best[2], s[r, q]), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) == k)
                floor[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    return scan


def tfidf_top(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """``(query_id, id, score, rank)``: for each query vector the k corpus vectors of highest
    cosine above zero, the newer (higher id) first on ties.

    Both are ``(id, terms map<string,int>)``. As in a search for one failure, the corpus of each
    query is all rows but itself, plus the query: idf counts are those of the whole corpus table.
    Queries are read in blocks of ``BLOCK_QUERIES``; each block is an inverted index that every
    partition of the corpus runs against, keeping k rows a query before anything is shuffled.
    Terms meet by 64-bit hash.
    """
    scratch = Scratch(corpus.sparkSession)
    rows = term_rows(corpus, "id", F.col("terms"))
    idfs = scratch.save(idf(rows, F.lit(corpus.count())))
    vectors = lambda df: weights(term_rows(df, "id", F.col("terms")), idfs).groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")).alias("v")).select(F.col("id").cast("long").alias("id"), F.col("v.t").alias("t"), F.col("v.w").alias("w"))
    mine = scratch.save(vectors(corpus))
    asked = vectors(queries)
    schema = "query_id long, id long, score double"
    out = None
    block: list = []

    def run_block(block: list) -> DataFrame:
        return spread(mine).mapInArrow(_top_of_block(_Block(block), k), schema)

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_QUERIES:
            out = run_block(block) if out is None else out.unionByName(run_block(block))
            block = []
    if block:
        out = run_block(block) if out is None else out.unionByName(run_block(block))
    if out is None:
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top(queries: DataFrame, corpus: DataFrame, k: int = 3, block: int = 4096) -> DataFrame:
    """``(query_id, id, score, rank)``: the k nearest other vectors by cosine, exactly.

    Both are ``(id, v array<float>)``. Queries are a stated set, read in blocks; each block is one
    matrix product per batch of the corpus. Null, empty and zero vectors are left out.
    """
    schema = "query_id long, id long, score double"
    ok = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("size(v) > 0 AND exists(v, x -> x <> 0)")
    mine, out = ok(corpus), None

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def run_block(rows: list) -> DataFrame:
        qid, q = np.array([r.id for r in rows], np.int64), unit(np.array([r.v for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                c = unit(b.column(1).values.to_numpy(zero_copy_only=False)[b.column(1).offsets[0].as_py() : b.column(1).offsets[-1].as_py()].reshape(len(ids), -1))
                s = np.round(q @ c.T, 10)
                s[qid[:, None] == ids[None, :]] = -2
                top = list(_merge_top(s, ids, k, -1.5))
                yield pa.RecordBatch.from_arrays([pa.array([int(qid[x[0]]) for x in top], pa.int64()), pa.array([x[1] for x in top], pa.int64()), pa.array([x[2] for x in top], pa.float64())], names=["query_id", "id", "score"])

        return spread(mine).mapInArrow(scan, schema)

    rows: list = []
    for r in ok(queries).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out = run_block(rows) if out is None else out.unionByName(run_block(rows))
            rows = []
    if rows:
        out = run_block(rows) if out is None else out.unionByName(run_block(rows))
    if out is None:
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
