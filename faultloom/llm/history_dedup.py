"""Deduplicating new batches against everything accepted before.

A record's text is the ascending sequence of its distinct terms. Sequences are concatenated, per
time block and batch, into immutable suffix-array segments. A batch record looks up its own
substrings by binary search; the lengths of the matches add up to a coverage for each older
record, and records covered enough are verified exactly. Segments of equal rank are merged, so
there are never more than log2(batches) of them to search.

Why no pair is lost. Let two sets share I terms and differ in D, with I/(I+D) >= 7/10. In the
merged sequence the D terms cut the shared ones into at most D+1 runs, and a run is a common
substring. A run of m terms holds m - (k-1) substrings of k terms, so at least I - (k-1)(D+1) of
them match in all. For k = 2 that is at least 1 always, for k = 3 once the larger set has 22
terms, and from then on it grows with the size (:func:`least_matches`). Sets of one term match as
a whole.

Copies and order. Links are found between contents, of which two rows a stretch of the window are
looked at (:func:`thinned`). Who is refused then follows from one pass in order over each part of
the time line (:func:`decide`), with lists of accepted times instead of pairs of records.

Why time cells. A record concerns only records at most ``window`` away, so a block of a day
holds all partners but those of its edges, where probes enter two blocks. A crowded day is cut by
time into up to day/window cells: index rows lie in one of them, probes in at most three. A cell
that is crowded still is cut by content: a record enters the shards of its first n - ceil(t*n) + 1
terms, rare terms before frequent ones, and two sets within likeness t share one of these. So a
record is copied a bounded number of times, however many others its day holds.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.llm.neardup import flag_array, flagged, term_hashes
from faultloom.session import Scratch

BLOCK_US = 24 * 3600 * 1_000_000
SMALL = 22  # from this size on of the larger set, three terms in a row must match somewhere
SHARD_ROWS = 40_000
SLICE = 4_000_000  # occurrences looked at together
PART_ROWS = 1_000_000  # records whose order is settled in one task
_T = 38  # bits for the time within a block


def least_matches(n_a: np.ndarray, n_b: np.ndarray, likeness: Fraction) -> np.ndarray:
    """How many substrings of three terms two sets within likeness must share at least.

    With U = I + D terms in either: I - 2(D + 1) >= (3t - 2) U - 2, and U is at least the larger
    size; for t > 2/3 the bound grows with U.
    """
    u = np.maximum(n_a, n_b).astype(np.int64)
    p, q = likeness.numerator, likeness.denominator
    return np.maximum(1, -((-(3 * p - 2 * q) * u) // q) - 2)


@dataclass
class Records:
    """Records with term sequences ``h[off[i]:off[i+1]]``, times within the block and an order."""

    order: np.ndarray
    at: np.ndarray
    off: np.ndarray
    h: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    def take(self, rows: np.ndarray) -> Records:
        n = self.sizes[rows]
        off = np.append(0, np.cumsum(n))
        src = np.repeat(self.off[rows], n) + np.arange(off[-1]) - np.repeat(off[:-1], n)
        return Records(self.order[rows], self.at[rows], off, self.h[src])

    @staticmethod
    def join(a: Records, b: Records) -> Records:
        return Records(np.append(a.order, b.order), np.append(a.at, b.at), np.append(a.off, b.off[1:] + a.off[-1]), np.append(a.h, b.h))


def _slices(owner: np.ndarray, n: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of whole owners with about ``most`` in all; ``owner`` ascends."""
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
        end = int(np.searchsorted(owner, owner[min(max(end, at), len(n) - 1)], "right" if end <= at or end >= len(n) else "left"))
        end = max(end, int(np.searchsorted(owner, owner[at], "right")))
        yield slice(at, end)
        at = end


def _next(r: np.ndarray, off: np.ndarray, step: int) -> np.ndarray:
    """The value ``step`` places on within the same record, else -1."""
    out = np.full(len(r), -1, np.int64)
    end = np.repeat(off[1:], np.diff(off))
    ok = np.arange(len(r)) + step < end
    out[ok] = r[np.flatnonzero(ok) + step]
    return out


def _rank(u: np.ndarray, x: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """Place of each value in the sorted ``u`` by binary search, -1 where it is absent."""
    if not len(u):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(u, x), len(u) - 1)
    hit = u[at] == x
    return np.where(hit if valid is None else hit & valid, at, -1)


class Segment:
    """Immutable suffix array over concatenated records, in lexicographic order to depth 3.

    Suffixes are ranked by prefix doubling: terms, then pairs, then triples. ``tri`` holds the
    sorted (triple rank, time) of all suffixes of three terms, ``duo`` those of (pair rank, time)
    for small records, so one binary search finds a substring's occurrences within a time window.
    """

    def __init__(self, rec: Records):
        self.rec = rec
        r1, self.terms = np.unique(rec.h, return_inverse=True)[1], np.unique(rec.h)
        self.base = len(self.terms) + 2
        n1, n2 = _next(r1, rec.off, 1), _next(r1, rec.off, 2)
        k2 = r1 * self.base + n1 + 1
        self.pairs = np.unique(k2)
        r2 = np.searchsorted(self.pairs, k2)
        k3 = r2 * self.base + n2 + 1
        own = np.repeat(np.arange(len(rec.at)), rec.sizes)
        full = n2 >= 0
        self.triples = np.unique(k3[full])
        self.tri, self.tri_own = self._sorted(np.searchsorted(self.triples, k3[full]), own[full])
        small = (rec.sizes[own] < SMALL) & ((n1 >= 0) | (rec.sizes[own] == 1))
        self.duo, self.duo_own = self._sorted(r2[small], own[small])

    def _sorted(self, rank: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (rank.astype(np.int64) << _T) | self.rec.at[own]
        o = np.argsort(key, kind="stable")
        return key[o], own[o]

    @staticmethod
    def merge(a: Segment, b: Segment) -> Segment:
        return Segment(Records.join(a.rec, b.rec))

    def probe(self, q: Records, window: int, likeness: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """``(probe row, own row)``: all pairs within window and likeness."""
        qn = np.repeat(np.arange(len(q.at)), q.sizes)
        r1 = _rank(self.terms, q.h)
        n1, n2 = _next(r1, q.off, 1), _next(r1, q.off, 2)
        alone = q.sizes[qn] == 1
        r2 = _rank(self.pairs, r1 * self.base + n1 + 1, (r1 >= 0) & ((n1 >= 0) | alone))
        r3 = _rank(self.triples, r2 * self.base + n2 + 1, (r2 >= 0) & (n2 >= 0))
        found = []
        for rank, keys, own, need in ((r3, self.tri, self.tri_own, True), (np.where(q.sizes[qn] < SMALL, r2, -1), self.duo, self.duo_own, False)):
            p = np.flatnonzero(rank >= 0)
            t = q.at[qn[p]]
            top = (1 << _T) - 1
            lo = np.searchsorted(keys, (rank[p] << _T) | np.clip(t - window, 0, top), "left")
            hi = np.searchsorted(keys, (rank[p] << _T) | np.clip(t + window, 0, top), "right")
            n = np.where(t + window < 0, 0, np.maximum(hi - lo, 0))
            # a crowded window is worked off in slices of whole probes, so memory stays bounded
            for cut in _slices(qn[p], n, SLICE):
                m, l0 = n[cut], lo[cut]
                at = np.repeat(l0, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                pair, cover = np.unique(np.repeat(qn[p][cut], m) * len(self.rec.at) + own[at], return_counts=True)
                if need:
                    a, b = q.sizes[pair // len(self.rec.at)], self.rec.sizes[pair % len(self.rec.at)]
                    pair = pair[(cover >= least_matches(a, b, likeness)) & (np.maximum(a, b) >= SMALL)]
                found.append(self._verify(q, pair, likeness))
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // len(self.rec.at), pair % len(self.rec.at)

    def _verify(self, q: Records, pair: np.ndarray, likeness: Fraction) -> np.ndarray:
        i, j = pair // len(self.rec.at), pair % len(self.rec.at)
        a, b = q.sizes[i], self.rec.sizes[j]
        ok = np.minimum(a, b) * likeness.denominator >= np.maximum(a, b) * likeness.numerator
        pair, i, j, a, b = pair[ok], i[ok], j[ok], a[ok], b[ok]
        shared = np.array([len(np.intersect1d(q.h[q.off[x] : q.off[x + 1]], self.rec.h[self.rec.off[y] : self.rec.off[y + 1]], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        return pair[shared * likeness.denominator >= (a + b - shared) * likeness.numerator]

    _ARRAYS = ("terms", "pairs", "triples", "tri", "tri_own", "duo", "duo_own")

    def arrays(self) -> dict[str, np.ndarray]:
        """All there is of it, to be stored."""
        return {"order": self.rec.order, "at": self.rec.at, "off": self.rec.off, "h": self.rec.h, **{k: getattr(self, k) for k in self._ARRAYS}}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> Segment:
        s = Segment.__new__(Segment)
        s.rec = Records(*(arrays[k] for k in ("order", "at", "off", "h")))
        for k in Segment._ARRAYS:
            setattr(s, k, arrays[k])
        s.base = len(s.terms) + 2
        return s


def thinned(rec: Records, window: int) -> np.ndarray:
    """Rows to keep of records whose ``order`` names their content.

    Of equal contents within one stretch of ``window`` the first and the last stand for all: what
    is at most ``window`` away from one between them is as near to one of the two. So a content
    that repeats without end costs two rows a stretch.
    """
    if not len(rec.at):
        return np.zeros(0, np.int64)
    stretch = rec.at // window
    o = np.lexsort((rec.at, stretch, rec.order))
    new = np.append(True, (rec.order[o][1:] != rec.order[o][:-1]) | (stretch[o][1:] != stretch[o][:-1]))
    return np.sort(o[new | np.append(new[1:], True)])


class Segments:
    """Segments by rank, merged like a binary counter as batches are added."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Segment]] = []

    def add(self, rec: Records) -> None:
        s, rank = Segment(rec), 0
        while self.held and self.held[-1][0] == rank:
            s, rank = Segment.merge(self.held.pop()[1], s), rank + 1
        self.held.append((rank, s))

    def probe(self, q: Records, window: int, likeness: Fraction):
        for _, s in self.held:
            i, j = s.probe(q, window, likeness)
            if len(i):
                yield q.order[i], s.rec.order[j]


def _records(t: pa.Table) -> Records:
    t = t.combine_chunks()
    h = t.column("h").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64()))
    off = h.offsets.to_numpy().astype(np.int64) if t.num_rows else np.zeros(1, np.int64)
    return Records(t.column("ord").to_numpy(), t.column("rel").to_numpy(), off - off[0], h.values.to_numpy()[off[0] : off[-1]])


_EDGE = pa.schema([("later", pa.int64()), ("earlier", pa.int64())])


def _edges(later: list[np.ndarray], earlier: list[np.ndarray]) -> pa.Table:
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(cat(later), pa.int64()), pa.array(cat(earlier), pa.int64())], schema=_EDGE)


def _against_history(window: int, likeness: Fraction):
    def run(index: pa.Table, probes: pa.Table) -> pa.Table:
        if not index.num_rows or not probes.num_rows:
            return _edges([], [])
        old = _records(index)
        i, _ = Segment(old.take(thinned(old, window))).probe(q := _records(probes), window, likeness)
        hit = q.order[np.unique(i)]
        return _edges([hit], [np.full(len(hit), -1)])

    return run


def _among_batches(window: int, likeness: Fraction):
    def run(index: pa.Table, probes: pa.Table) -> pa.Table:
        if not index.num_rows or not probes.num_rows:
            return _edges([], [])
        old, new = _records(index), _records(probes)
        old_batch, new_batch = index.column("batch").to_numpy(), probes.column("batch").to_numpy()
        # links are between contents, so each content is looked at twice a stretch at most
        i, j = thinned(old, window), thinned(new, window)
        old, new, old_batch, new_batch = old.take(i), new.take(j), old_batch[i], new_batch[j]
        held, later, earlier = Segments(), [], []
        for b in np.unique(np.append(old_batch, new_batch)):
            mine = np.flatnonzero(old_batch == b)
            if len(mine):
                held.add(old.take(mine))
            asked = np.flatnonzero(new_batch == b)
            if len(asked):
                for x, y in held.probe(new.take(asked), window, likeness):
                    ok = x != y
                    later.append(x[ok])
                    earlier.append(y[ok])
        return _edges(later, earlier)

    return run


def _block(at: Column) -> Column:
    return F.floor(at / F.lit(BLOCK_US)).cast("long")


def _spread_to_shards(frequent, likeness: Fraction):
    """Rows ``(block, sub, shards, ord, batch, rel, h)`` to ``(block, sub, shard, ord, batch, h, rel)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            shards = b.column("shards").to_numpy().astype(np.int64)
            h = b.column("h")
            off = h.offsets.to_numpy().astype(np.int64)
            x = h.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            off = off - off[0]
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), n)
            common = flagged(frequent.value, x) if frequent else np.zeros(len(x), bool)
            o = np.lexsort((x, common, row))
            place = np.arange(len(x)) - np.repeat(off[:-1], n)
            many = shards > 1
            use = many[row] & (place < (n + (-likeness.numerator * n) // likeness.denominator + 1)[row])
            to = np.unique(np.stack([row[use], (x[o][use].view(np.uint64) >> np.uint64(20)).astype(np.int64) % shards[row[use]]]), axis=1) if use.any() else np.zeros((2, 0), np.int64)
            one = np.flatnonzero(~many)
            take, shard = np.append(one, to[0]), np.append(np.zeros(len(one), np.int64), to[1])
            rows = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([rows.column("block"), rows.column("sub"), pa.array(shard.astype(np.int32)), *(rows.column(c) for c in ("ord", "batch", "h", "rel"))], names=["block", "sub", "shard", "ord", "batch", "h", "rel"])

    return run


_PLACED = "block long, sub int, shard int, ord long, batch long, h array<long>, rel long"


def _placed(index: DataFrame, probes: DataFrame, window: int, likeness: Fraction, shard_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Index rows and probes ``(ord, batch, at, h)`` in the cells and shards where they meet.

    Cells hold about ``shard_rows`` index rows; a row is copied to at most three cells and, in
    crowded ones, to as many shards as its prefix has terms.
    """
    finest = max(1, BLOCK_US // max(1, window))
    rel = (F.col("at") - F.col("block") * F.lit(BLOCK_US)).alias("rel")
    own = lambda df: df.select(*[F.col(c).alias(c) for c in ("ord", "batch", "at", "h")])  # noqa: E731  fresh names: both may be one table
    index = own(index).withColumn("block", _block(F.col("at"))).select("*", rel)
    probes = own(probes).withColumn("block", F.explode(F.sequence(_block(F.col("at") - window), _block(F.col("at") + window)))).select("*", rel)
    cuts = index.groupBy("block").agg(F.least(F.lit(finest), F.ceil(F.count("*") / shard_rows)).cast("int").alias("cuts"))  # one row a day
    cell = lambda c: F.least(F.col("cuts") - 1, F.greatest(F.lit(0), F.floor(c * F.col("cuts") / F.lit(BLOCK_US)))).cast("int")
    index = index.join(cuts, "block").withColumn("sub", cell(F.col("rel")))
    probes = probes.join(cuts, "block").withColumn("sub", F.explode(F.sequence(cell(F.col("rel") - window), cell(F.col("rel") + window))))
    cells, most = scratch.save_with(index.groupBy("block", "sub").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), m=F.max("shards"))
    frequent = None
    if (most["m"] or 1) > 1:
        crowded = index.join(cells.where("shards > 1"), ["block", "sub"], "left_semi")
        frequent = flag_array(crowded.select(F.explode("h").alias("x")).groupBy("x").count().where(F.col("count") > max(1, shard_rows // 40)))
        frequent = index.sparkSession.sparkContext.broadcast(frequent)
    out = [df.join(cells, ["block", "sub"]).select("block", "sub", "shards", "ord", "batch", "rel", "h").mapInArrow(_spread_to_shards(frequent, likeness), _PLACED) for df in (index, probes)]
    return out[0], out[1]


_CELL = ["block", "sub", "shard"]


def _cogrouped(index: DataFrame, probes: DataFrame, window: int, likeness: Fraction, run, shard_rows: int, scratch: Scratch) -> DataFrame:
    """Bring probes and the index rows of their cells together."""
    i, p = _placed(index, probes, window, likeness, shard_rows, scratch)
    return i.groupBy(*_CELL).cogroup(p.groupBy(*_CELL)).applyInArrow(run, "later long, earlier long")


def decide(rows: list[tuple], near: dict[int, set], window: int) -> list[tuple[int, int]]:
    """First come, first served: ``rows (ord, at, grp, content, status, own)`` in rising order.

    A row is refused (2) if an accepted (1) row before it shares its ``grp``, or lies within the
    window with an equal or linked content. Rows of other parts (not ``own``) may be undecided (0);
    what depends on one stays undecided as well, unless it is refused anyway. Equal and linked
    contents within a window accept one row, so the lists searched stay short.
    """
    accepted: tuple[set, dict] = (set(), {})
    unknown: tuple[set, dict] = (set(), {})

    def within(times: dict, content, at: int) -> bool:
        for c in (content, *near.get(content, ())):
            t = times.get(c)
            if t:
                k = bisect_left(t, at - window)
                if k < len(t) and t[k] <= at + window:
                    return True
        return False

    def touches(known: tuple[set, dict], grp, content, at: int) -> bool:
        return grp is not None and grp in known[0] or content is not None and within(known[1], content, at)

    out = []
    for ord_, at, grp, content, status, own in rows:
        if not status and own:
            status = 2 if touches(accepted, grp, content, at) else 0 if touches(unknown, grp, content, at) else 1
            out.append((ord_, status))
        if status != 2:
            known = accepted if status else unknown
            if grp is not None:
                known[0].add(grp)
            if content is not None:
                insort(known[1].setdefault(content, []), at)
    return out


def _decide_part(window: int):
    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        near: dict[int, set] = {}
        for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
            near.setdefault(a, set()).add(b)
        rows = sorted(zip(*(nodes.column(c).to_pylist() for c in ("ord", "at", "grp", "content", "status", "own"))), key=lambda r: r[0])
        got = decide(rows, near, window)
        return pa.table({"ord": pa.array([x[0] for x in got], pa.int64()), "status": pa.array([x[1] for x in got], pa.int32())})

    return run


def _first_come(nodes: DataFrame, links: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``(ord)`` of refused ``nodes (ord, at, grp, content)`` under ``links (a, b)`` of contents.

    Nodes are cut by time into parts of bounded size that are decided side by side; a part also
    sees the nodes up to a window beyond its borders. What depends on a neighbour's undecided node
    waits for the next round; each round decides at least the first node of all that wait, and
    chains in order of time, the worst case, take as many rounds as there are parts.
    """
    todo, n = scratch.save_with(nodes.withColumn("status", F.lit(0)), n=F.count(F.lit(1)))
    both = scratch.save(links.union(links.select("b", "a")).distinct())
    parts = max(1, -(-n["n"] // PART_ROWS))
    # borders lie between whole seconds, so no grp is cut
    cuts = sorted({int(c) // 1_000_000 * 1_000_000 for c in todo.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)])).first()[0]}) if parts > 1 else []
    side = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= c)) if cuts else F.lit(0)
    while True:
        x = todo.withColumn("mine", side(F.col("at"))).withColumn("part", F.explode(F.sequence(side(F.col("at") - window), side(F.col("at") + window))))
        x = x.withColumn("own", F.col("part") == F.col("mine"))
        near = both.join(x.where("content IS NOT NULL").select(F.col("content").alias("a"), "part").distinct(), "a").select(F.col("part").alias("part"), "a", "b")
        x = x.select(F.col("part").alias("part"), "ord", "at", "grp", "content", "status", "own")
        got, left = scratch.save_with(x.groupBy("part").cogroup(near.groupBy("part")).applyInArrow(_decide_part(window), "ord long, status int"), n=F.count_if(F.col("status") == 0))
        now = got.withColumnRenamed("status", "new")
        todo = scratch.save(todo.join(now, "ord", "left").select("ord", "at", "grp", "content", F.coalesce("new", "status").alias("status")))
        if not left["n"]:
            return todo.where("status = 2").select("ord")


def refused_records(
    history: DataFrame, incoming: DataFrame, history_terms: Column, incoming_terms: Column, record_id: str = "record_id", batch: str = "batch_no", time: str = "analyzed_at", key: str = "fingerprint",
    likeness: Fraction = Fraction(7, 10), window_seconds: int = 900, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(record_id)``: records of ``incoming`` that repeat what was accepted before them.

    Records are taken in order of batch, then id. One is refused if an accepted row (all of
    ``history``, and every earlier record that was not refused) has the same key and the same
    time cut to whole seconds, or lies at most ``window_seconds`` away with a likeness of at least
    ``likeness``. Rows with a null time match nothing; a null key never equals another; rows
    without terms have no likeness; records with a null id or batch are left out; a repeated
    record id is one record; empty tables give no rows or refuse nothing; other columns are not
    read. Thresholds are inclusive.
    """
    if likeness < Fraction(7, 10):
        raise ValueError("below 0.7 the matches need not be long enough to be found")
    scratch = Scratch(history.sparkSession)
    window = window_seconds * 1_000_000
    old = history.select(*_shape(time, key), term_hashes(history_terms).alias("h")).where("at IS NOT NULL")
    new = _records_of(incoming, incoming_terms, record_id, batch, time, key, scratch)
    same = _same_second(new, old.select("fp", _SEC()))
    index = old.where("size(h) > 0").select(F.xxhash64("h").alias("ord"), F.lit(0).cast("long").alias("batch"), "at", "h")
    probes = new.where("size(h) > 0").join(same, "ord", "left_anti").select("ord", "batch", "at", "h")
    alike = _cogrouped(index, probes, window, likeness, _against_history(window, likeness), shard_rows, scratch).select(F.col("later").alias("ord"))
    return new.join(_refused(new, same, alike, window, likeness, shard_rows, scratch), "ord", "left_semi").select("record_id")


_ROWS = "ord long, at long, h array<long>, fp string"


def _SEC() -> Column:
    return F.floor(F.col("at") / 1_000_000).alias("sec")


def _shape(time: str, key: str) -> list[Column]:
    return [F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(key).cast("string").alias("fp")]


def _records_of(incoming: DataFrame, terms: Column, record_id: str, batch: str, time: str, key: str, scratch: Scratch) -> DataFrame:
    """``(record_id, batch, at, fp, h, ord)`` of the records that take part."""
    new = incoming.select(F.col(record_id).cast("long").alias("record_id"), F.col(batch).cast("long").alias("batch"), *_shape(time, key), term_hashes(terms).alias("h"))
    return scratch.save(_ordered(new.where("record_id IS NOT NULL AND batch IS NOT NULL AND at IS NOT NULL").dropDuplicates(["record_id"])))


def _same_second(new: DataFrame, seconds: DataFrame) -> DataFrame:
    return new.where("fp IS NOT NULL").select("ord", "fp", _SEC()).join(seconds.where("fp IS NOT NULL"), ["fp", "sec"], "left_semi").select("ord")


def _refused(new: DataFrame, same: DataFrame, alike: DataFrame, window: int, likeness: Fraction, shard_rows: int, scratch: Scratch) -> DataFrame:
    """``(ord)`` of the records refused for the history's sake and then for each other's."""
    by_history = scratch.save(same.union(alike).distinct())
    rest = scratch.save(new.join(by_history, "ord", "left_anti"))
    content = F.when(F.size("h") > 0, F.xxhash64("h"))
    body = rest.where("size(h) > 0").select(content.alias("ord"), "batch", "at", "h")
    links = _cogrouped(body, body, window, likeness, _among_batches(window, likeness), shard_rows, scratch).select(F.col("later").alias("a"), F.col("earlier").alias("b"))
    grp = F.when(F.col("fp").isNotNull(), F.concat_ws("|", _SEC().cast("string"), "fp"))
    among = _first_come(rest.select("ord", "at", grp.alias("grp"), content.alias("content")), links, window, scratch)
    return by_history.union(among).distinct()


def _ordered(new: DataFrame) -> DataFrame:
    """Add ``ord``: a number that rises with (batch, record_id), without sorting in one task."""
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = new.repartitionByRange(n, "batch", "record_id").sortWithinPartitions("batch", "record_id")
    return part.withColumn("ord", F.monotonically_increasing_id())


_SEGMENT = {"order": "long", "at": "long", "off": "long", "h": "long", "terms": "long", "pairs": "long", "triples": "long", "tri": "long", "tri_own": "long", "duo": "long", "duo_own": "long"}
_SEGMENT_SCHEMA = "block long, sub int, shard int, " + ", ".join(f"`{k}` array<{t}>" for k, t in _SEGMENT.items())


def _segment_row(cell: list[int], s: Segment) -> pa.Table:
    return pa.table({**{c: pa.array([v], pa.int64() if c == "block" else pa.int32()) for c, v in zip(_CELL, cell)}, **{k: pa.array([v.astype(np.int64)], pa.list_(pa.int64())) for k, v in s.arrays().items()}})


def _loaded(row: pa.Table) -> Segment:
    return Segment.of({k: np.array(row.column(k)[0].values.to_numpy(zero_copy_only=False)) for k in _SEGMENT})


class AcceptedHistory:
    """What was accepted so far, as immutable segments on shared storage.

    ``offer`` checks a new batch against all segments without rebuilding any, accepts what is not
    refused as a segment of rank 0, and merges segments of equal rank, so n batches lie in at most
    log2(n) + 1 segments and each record is merged log2(n) times in all. A segment is a directory
    that is never changed. The list of live ones is a manifest beside them: a new numbered file
    for each state, written whole under another name and then renamed, so a program that ends
    half-way leaves the state before it and the next one goes on from there.

    Within a segment each time cell of about ``shard_rows`` rows has its own arrays, stored by
    day, and a batch opens only the days its records can match in. Should more rows than that lie
    within one window, they are dealt over several arrays, each searched by the cell's probes.
    """

    def __init__(self, spark, path: str, window_seconds: int = 900, likeness: Fraction = Fraction(7, 10), shard_rows: int = SHARD_ROWS):
        self.spark, self.path, self.window, self.likeness, self.shard_rows = spark, path, window_seconds * 1_000_000, likeness, shard_rows
        self.live: list[tuple[int, str]] = []  # rank and directory
        self.made = self.state = 0
        self._resume()

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _resume(self) -> None:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/manifest-*.json"))
        if found:
            last = max(str(x.getPath()) for x in found)
            d = json.loads("\n".join(r.value for r in self.spark.read.text(last).collect()))
            self.live, self.made, self.state = [(r, n) for r, n in d["live"]], d["made"], d["state"]

    def commit(self) -> None:
        """Make the present segments the stored state."""
        fs, path = self._fs()
        self.state += 1
        part = path(f"{self.path}/_manifest.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.writeBytes(json.dumps({"state": self.state, "made": self.made, "live": self.live}))
        out.close()
        if not fs.rename(part, path(f"{self.path}/manifest-{self.state:09d}.json")):
            raise RuntimeError("another program has written this state")

    def _write(self, rows: DataFrame, rank: int) -> None:
        """``rows (ord, at, h, fp)`` as a new segment, merged at once with all those that its rank
        and the ranks it thereby reaches call for."""
        old = []
        while self.live and self.live[-1][0] == rank:
            old.append(f"{self.path}/{self.live.pop()[1]}/rows")
            rank += 1
        if old:
            rows = rows.select("ord", "at", "h", "fp").unionByName(self.spark.read.schema(_ROWS).parquet(*old))
        self.made += 1
        name = f"{self.made}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/{name}"
        rows.select("ord", "at", "h", "fp").write.parquet(f"{path}/rows")
        own = self.spark.read.schema(_ROWS).parquet(f"{path}/rows")
        own.where("fp IS NOT NULL").select("fp", _SEC()).distinct().write.parquet(f"{path}/seconds")
        finest = max(1, BLOCK_US // max(1, self.window))
        x = own.where("size(h) > 0").withColumn("block", _block(F.col("at"))).select("block", F.xxhash64("h").alias("ord"), "h", (F.col("at") - F.col("block") * F.lit(BLOCK_US)).alias("rel"))
        n = x.groupBy("block").agg(F.least(F.lit(finest), F.ceil(F.count("*") / self.shard_rows)).cast("int").alias("cuts"))
        x = x.join(n, "block").withColumn("sub", F.floor(F.col("rel") * F.col("cuts") / F.lit(BLOCK_US)).cast("int"))
        m = x.groupBy("block", "sub").agg(F.ceil(F.count("*") / self.shard_rows).cast("int").alias("shards"))
        x = x.join(m, ["block", "sub"]).select("block", "sub", F.pmod(F.xxhash64("h", "rel"), F.col("shards")).cast("int").alias("shard"), "ord", "h", "rel")
        window = self.window

        def build(t: pa.Table) -> pa.Table:
            return _segment_row([t.column(c)[0].as_py() for c in _CELL], Segment((r := _records(t)).take(thinned(r, window))))

        x.groupBy("block", "sub", "shard").applyInArrow(build, _SEGMENT_SCHEMA).write.partitionBy("block").parquet(f"{path}/index")
        self.live.append((rank, name))

    def accept(self, rows: DataFrame, terms: Column, time: str = "analyzed_at", key: str = "fingerprint") -> None:
        """Take rows in without a check, as one segment of the highest rank so far or of rank 10."""
        x = rows.select(*_shape(time, key), term_hashes(terms).alias("h")).where("at IS NOT NULL")
        rank = max((r for r, _ in self.live), default=9) + 1
        self._write(x.withColumn("ord", F.xxhash64("at", "fp", "h")), rank)
        self.commit()

    def _alike(self, probes: DataFrame, name: str) -> DataFrame:
        """``(ord)`` of probes that some row of a segment is like, by its stored arrays."""
        rel = F.col("at") - F.col("block") * F.lit(BLOCK_US)
        p = probes.withColumn("block", F.explode(F.sequence(_block(F.col("at") - self.window), _block(F.col("at") + self.window))))
        days = [r.block for r in p.select("block").distinct().collect()]  # a number a day; other days' files are not opened
        seg = self.spark.read.schema(_SEGMENT_SCHEMA).parquet(f"{self.path}/{name}/index").where(F.col("block").isin(days))
        window, likeness = self.window, self.likeness
        # the stretch of time that a cell's rows really cover, so a probe enters only cells it can match in
        ends = seg.select(*_CELL, F.array_min("at").alias("lo"), F.array_max("at").alias("hi"))
        p = p.join(ends, "block").where((rel + window >= F.col("lo")) & (rel - window <= F.col("hi"))).select(*[F.col(c).alias(c) for c in _CELL], "ord", "h", rel.alias("rel"))

        def run(index: pa.Table, probes: pa.Table) -> pa.Table:
            if not index.num_rows or not probes.num_rows:
                return _edges([], [])
            x, _ = _loaded(index).probe(q := _records(probes), window, likeness)
            hit = q.order[np.unique(x)]
            return _edges([hit], [np.full(len(hit), -1)])

        return seg.groupBy(*_CELL).cogroup(p.groupBy(*_CELL)).applyInArrow(run, "later long, earlier long").select(F.col("later").alias("ord"))

    def offer(self, batch: DataFrame, terms: Column, record_id: str = "record_id", batch_no: str = "batch_no", time: str = "analyzed_at", key: str = "fingerprint") -> DataFrame:
        """``(record_id)`` refused of a batch; the others are part of the history from now on."""
        scratch = Scratch(self.spark)
        new = _records_of(batch, terms, record_id, batch_no, time, key, scratch)
        same = alike = new.select("ord").where("false")
        for _, name in self.live:
            same = same.union(_same_second(new, self.spark.read.parquet(f"{self.path}/{name}/seconds")))
        same = scratch.save(same.distinct())
        probes = new.where("size(h) > 0").join(same, "ord", "left_anti").select("ord", "at", "h")
        for _, name in self.live:
            alike = alike.union(self._alike(probes, name))
        no = scratch.save(_refused(new, same, alike, self.window, self.likeness, self.shard_rows, scratch))
        self._write(new.join(no, "ord", "left_anti"), 0)
        self.commit()
        return new.join(no, "ord", "left_semi").select("record_id")


def refused_by_batches(history: DataFrame, incoming: DataFrame, history_terms: Column, incoming_terms: Column, path: str, record_id: str = "record_id", batch: str = "batch_no", time: str = "analyzed_at", key: str = "fingerprint", together: int = 1) -> DataFrame:
    """``(record_id)`` refused when the batches of ``incoming`` are offered one after the other, or
    some ``together``, to the segments stored under ``path``; rows as of :func:`refused_records`.

    The history is read once, into the first segment, and never again. Batches are a few numbers,
    read on the driver; nulls are left out, as are further copies of a record id.
    """
    kept = AcceptedHistory(history.sparkSession, path)
    if not kept.live:
        kept.accept(history, history_terms, time, key)
    first = Window.partitionBy(record_id).orderBy(batch)
    once = incoming.where(F.col(batch).isNotNull() & F.col(record_id).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    out = None
    numbers = [r.b for r in once.select(F.col(batch).alias("b")).distinct().orderBy("b").collect()]
    for at in range(0, len(numbers), together):
        got = kept.offer(once.where(F.col(batch).isin(numbers[at : at + together])), incoming_terms, record_id, batch, time, key)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else incoming.sparkSession.createDataFrame([], "record_id long")
