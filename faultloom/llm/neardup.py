"""Near-duplicate records: all pairs of term sets with a likeness (Jaccard) of at least t.

A term set is a bit vector; two sets of sizes a and b with likeness t or more lie within Hamming
radius f*(a+b), f = (1-t)/(1+t). Covering locality-sensitive hashing puts every vector into one
table per structured bit mask, under the bits the mask selects, such that any two vectors within
the radius agree in some table, with certainty and not just with some probability.

Covering masks. Each coordinate i gets a part by hash and a code c(i) in GF(2)^q without the zero
code; for every part and non-zero v there is a mask that selects the part's coordinates with
<c(i), v> = 1. d coordinates that differ within a part leave at least 2^(q-d) - 1 of its masks
untouched, so over p parts two vectors at distance r agree in at least M(r) tables
(:func:`least_agreements`), which is positive up to r = p*q - 1.

Terms of one row alone. A term that occurs in a single row always differs. So these are left out
of the vectors and lower the radius of a pair to w(A) + w(B) with w(X) = f*|X| - singles(X).

Tables grow with the size. A table family belongs to a range of sizes, its number of parts to the
radius there; a pair meets in the family of its larger set, so a set enters its own family and,
near the upper edge, the next one.

Bounded buckets. Only buckets of at most ``bucket`` rows are paired. Larger ones, and empty
selections, are refined: let a set have E empty and H overfull ones among its masks. A pair that
meets in no live bucket has M(r) <= E + H on both sides, and as r <= 2w for the one of larger w,
that one has M(2w) <= E + H as well. So only such sets, called open, are looked up once more, by
exact prefixes in the global order (rarer terms first, by level of frequency): the smaller set's
first a - ceil(2t/(1+t)*a) + 1 terms and the larger one's first b - ceil(t*b) + 1 terms share one.
For all other pairs the masks are a proof by themselves.

Frequent prefix terms. Rows that share one prefix term are divided by the second term they share,
those still many by the third, and so on up to ``DEPTH``: a pair that has o terms in common has its
l-th common term, l <= o, within the first l - 1 places beyond the prefixes. A row carries the
places that follow along with its term, so this needs no further shuffle, and a term's rows are
compared with each other only where few are left. Pairs that need no further term in common (one
set is hardly more than the terms shared so far) are compared before the rows are divided.

What tasks know of terms and buckets (levels of frequency, overfull) are bit arrays of fixed size,
indexed by hash. A collision errs on the safe side only: a single term kept in the vectors, a rare
term ordered among the frequent, a bucket refined instead of paired.

Records with equal term sets enter once. Within a bucket a 128-bit parity sketch, whose Hamming
distance never exceeds that of the sets, drops pairs outside the radius before anything is
shuffled; survivors are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.operators.components import min_label_components
from faultloom.session import Scratch

BUCKET = 1000
FLAG_BITS = 1 << 26  # 8 MiB per bit array, whatever the data
Q = 2  # code bits of a part: 3 masks
FIRST_SIZE = 128  # sets up to this size share the first family of tables
GROUP_ROWS = 50_000  # rows of sorted buckets paired together
LEVELS = (1, 8, 64, 256, 2048, 16384)  # a term of more rows than these comes later in the order
DIVIDED = 4  # terms of so many levels and above may be divided by further terms
FEW = 64  # rows under a term that may be the smaller of a pair: not divided further
DEPTH = 4  # terms in common by which rows are divided at most
PAIRS_AT_ONCE = 1 << 20
ENTRIES = 1 << 21  # terms of rows that are divided at once
ROWS_AT_ONCE = 1 << 17
_FIELDS = [T.StructField("key", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())]
_KEYS = T.StructType(_FIELDS)
_PREFIX = T.StructType([*_FIELDS, T.StructField("place", T.IntegerType()), T.StructField("rest", T.BinaryType())])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(terms: Column) -> Column:
    """Distinct 64-bit hashes of a row's terms, ascending."""
    return F.array_sort(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t))))


def parity_sketch(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words per set; every term flips one of the 128 bits."""
    bit = (h.astype(np.uint64) >> np.uint64(7)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = bit < np.uint64(64)
    return tuple(np.bitwise_xor.reduceat(np.where(m, one, np.uint64(0)), starts).view(np.int64) for m in (low, ~low))


def flag_array(hashes: DataFrame, bits: int = FLAG_BITS) -> np.ndarray:
    """Bit array in which every value of the long column ``x`` is set at its hash.

    At most bits/64 words reach the driver, whatever the number of values.
    """
    at = F.pmod(F.col("x"), F.lit(bits))
    words = hashes.select(F.shiftrightunsigned(at, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod(x, {bits}) & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def flagged(flags: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x.view(np.uint64) & np.uint64(len(flags) * 64 - 1)
    return (flags[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def covering_keys(h: np.ndarray, row: np.ndarray, n_rows: int, parts: int, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """``(n_rows, tables)`` keys under structured masks that cover radius ``parts * q - 1``, and
    which of them selected nothing.

    ``h`` are the coordinates of all rows, ``row`` their row numbers. Each table's keys are
    distinct from any other table's.
    """
    m = mix(h)
    part = (m % np.uint64(parts)).astype(np.int64)
    code = ((m >> np.uint64(32)) % np.uint64(2**q - 1)).astype(np.int64) + 1
    weight = mix(m ^ np.uint64(0x5DEECE66D))
    tables = parts * (2**q - 1)
    out = np.zeros(n_rows * tables, np.uint64)
    ones = np.array([bin(x).count("1") & 1 for x in range(2**q)], bool)
    base = row * tables + part * (2**q - 1) - 1
    for v in range(1, 2**q):
        sel = ones[code & v]
        with np.errstate(over="ignore"):
            np.add.at(out, base[sel] + v, weight[sel])
    out = out.reshape(n_rows, tables)
    return mix(out ^ mix(np.arange(tables).astype(np.uint64) + np.uint64(1 + (parts << 20)))[None, :]), out == 0


def least_agreements(r: np.ndarray, parts: int, q: int = Q) -> np.ndarray:
    """In how many of the tables two vectors at distance ``r`` agree at least."""
    left = np.maximum(r, 0)
    out = np.full(len(r), parts * (2**q - 1))
    for k in range(q - 1, -1, -1):
        step = np.minimum(left, parts)
        out -= step * 2**k
        left = left - step
    return out


def family_parts(level: int, f: Fraction, q: int = Q) -> int:
    """Parts of the tables for sets of up to FIRST_SIZE * 2^level terms: the radius there is met."""
    return max(1, -(-(FIRST_SIZE << level) * f.numerator // (q * f.denominator)))


def _families(n: np.ndarray, likeness: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """``(level, rows)``: families a set of each size belongs to as the smaller or larger of a pair."""
    own = np.ceil(np.log2(np.maximum(n, 1) / FIRST_SIZE)).clip(0).astype(int)
    top = np.ceil(np.log2(np.maximum(n * likeness.denominator // likeness.numerator, 1) / FIRST_SIZE)).clip(0).astype(int)
    for level in range(int(own.min()), int(top.max()) + 1):
        rows = np.flatnonzero((own <= level) & (top >= level))
        if len(rows):
            yield level, rows


def _sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = b.column(1)
    off = col.offsets.to_numpy().astype(np.int64)
    h = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return b.column(0).to_numpy(zero_copy_only=False), off - off[0], h


def _masked(off: np.ndarray, h: np.ndarray, shared: np.ndarray, overfull: np.ndarray | None, f: Fraction, likeness: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Live mask keys of a batch, their rows, and which rows are open."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    known = flagged(shared, h)
    singles = n - np.bincount(row[known], minlength=len(n))
    reach = 2 * (n * f.numerator - singles * f.denominator) // f.denominator  # 2w
    is_open = np.zeros(len(n), bool)
    keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for level, some in _families(n, likeness):
        number = np.full(len(n), -1)
        number[some] = np.arange(len(some))
        use = known & (number[row] >= 0)
        parts = family_parts(level, f)
        # rows by the slice, so that huge sets need no huge table of keys
        step = max(1, 4_000_000 // (parts * (2**Q - 1)))
        at_h, at_row = h[use], number[row[use]]
        for s in range(0, len(some), step):
            mine = (at_row >= s) & (at_row < s + step) if len(some) > step else slice(None)
            count = min(step, len(some) - s)
            k, empty = covering_keys(at_h[mine], at_row[mine] - s, count, parts)
            k = k.view(np.int64)
            full = flagged(overfull, k.ravel()).reshape(k.shape) & ~empty if overfull is not None else np.zeros(k.shape, bool)
            who = some[s : s + count]
            is_open[who] |= least_agreements(reach[who], parts) <= (empty | full).sum(1)
            live = ~(empty | full)
            keys.append(k[live])
            rows.append(np.repeat(who, live.sum(1)))
    return np.concatenate(keys), np.concatenate(rows), is_open


def _emit(shared, overfull, f: Fraction, likeness: Fraction, bare: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep, off, h = _sets(b)
            keys, r, _ = _masked(off, h, shared.value, overfull.value if overfull else None, f, likeness)
            if bare:
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])
                continue
            s1, s2 = parity_sketch(h, off[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep[r]), pa.array(np.diff(off)[r].astype(np.int32)), pa.array(s1[r]), pa.array(s2[r])], names=_KEYS.names)

    return run


def near(n_a, n_b, x1, x2, f: Fraction, likeness: Fraction) -> np.ndarray:
    """Whether sizes and the XOR of the sketches allow the likeness."""
    ok = np.minimum(n_a, n_b) * likeness.denominator >= np.maximum(n_a, n_b) * likeness.numerator
    differ = np.bitwise_count(x1.view(np.uint64)).astype(np.int64) + np.bitwise_count(x2.view(np.uint64))
    return ok & (differ * f.denominator <= (n_a + n_b) * f.numerator)


def pairs_of_buckets(key, rep, n, s1, s2, f: Fraction, likeness: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with one key, rows sorted by key, that sizes and sketches allow."""
    end = np.searchsorted(key, key, "right")
    at = np.arange(len(key))
    a, b = [], []
    step = 1
    while len(at := at[at + step < end[at]]):
        to = at + step
        ok = near(n[at], n[to], s1[at] ^ s1[to], s2[at] ^ s2[to], f, likeness)
        a.append(rep[at[ok]])
        b.append(rep[to[ok]])
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return np.minimum(a, b), np.maximum(a, b)


def prefix_lengths(n: np.ndarray, likeness: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Terms of which the first common one is among, for a set as the smaller and as the larger."""
    p, q = likeness.numerator, likeness.denominator
    return n + (-2 * p * n) // (p + q) + 1, n + (-p * n) // q + 1


def _first_with_rest(group, sm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, first, end)``: rows by group, those that may be the smaller first; for each of
    these its place in that order and the end of its group."""
    order = np.lexsort((~sm, group))
    g = group[order]
    first = np.flatnonzero(sm[order])
    return order, first, np.searchsorted(g, g[first], "right")


def _pairs(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every place of ``first`` with all later ones of its group, some at a time."""
    many = end - first - 1
    edge = np.cumsum(many)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        m = many[at:to]
        i = np.repeat(first[at:to], m)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        at = to


def pairs_of_prefixes(key, rep, n, s1, s2, place, is_open, off, rest, f: Fraction, likeness: Fraction, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with one prefix term, of which one is open, that sizes and sketches allow.

    ``rest[off[i]:off[i + 1]]`` are the terms that follow the place of row i in the order.
    """
    as_smaller, as_larger = prefix_lengths(n, likeness)
    p, q = likeness.numerator, likeness.denominator
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def compare(row, at, group, begins, depth: int) -> None:
        order, first, end = _first_with_rest(group, begins)
        r = row[order]
        size, opened, may = n[r], is_open[r], at[order] < as_smaller[r] + depth - 1
        for i, j in _pairs(first, end):
            ok = np.minimum(size[i], size[j]) * q >= np.maximum(size[i], size[j]) * p
            # the smaller set has to be one that may be; of equal sizes either
            ok &= (opened[i] | opened[j]) & ((size[i] <= size[j]) | may[j])
            i, j = r[i[ok]], r[j[ok]]
            # two terms of a row may have one short hash
            ok = (i != j) & near(n[i], n[j], s1[i] ^ s1[j], s2[i] ^ s2[j], f, likeness)
            i, j = rep[i[ok]], rep[j[ok]]
            found.append((np.minimum(i, j), np.maximum(i, j)))

    def divide(row, at, group, depth: int) -> None:
        """Rows with places ``at`` of their last common term so far, which is their ``depth``-th."""
        group = np.unique(group, return_inverse=True)[1]
        sm = at < as_smaller[row] + depth - 1
        small = np.bincount(group[sm], minlength=len(group))
        some = small[group] > 0
        row, at, group, sm = row[some], at[some], group[some], sm[some]
        more = np.bincount(group[off[row + 1] > off[row]], minlength=len(small)) > 0  # rare terms come without others
        whole = ~((small > few) & more & (depth < DEPTH))[group]
        # of rows that are divided: those that, as the smaller, need no further term in common
        done = sm & (-((-2 * p * n[row]) // (p + q)) <= depth)
        compare(row, at, group, np.where(whole, sm, done), depth)
        keep = np.flatnonzero(~whole)
        keep = keep[np.argsort(group[keep], kind="stable")]
        r, last, g = row[keep], at[keep], group[keep]
        # places after the last one, up to those that the next common term can have
        begin = off[r] + last - place[r]
        many = np.maximum(np.minimum(off[r + 1], off[r] + as_larger[r] + depth - place[r] - 1) - begin, 0)
        edge = np.append(0, np.cumsum(many))
        at_group = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)]), len(g))
        k = 0
        while k < len(at_group) - 1:
            i = at_group[k]
            k = max(k + 1, int(np.searchsorted(edge[at_group], edge[i] + ENTRIES, "right")) - 1)
            j = at_group[k]
            slices = int(edge[j] - edge[i]) // ENTRIES + 1  # of a large group: some of its terms at a time
            for x in range(slices):
                parts = []
                for u in range(i, j, ROWS_AT_ONCE):
                    z = slice(u, min(j, u + ROWS_AT_ONCE))
                    m = many[z]
                    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    term = rest[np.repeat(begin[z], m) + step].astype(np.int64)
                    mine = term % slices == x
                    parts.append((np.repeat(r[z], m)[mine], (np.repeat(last[z], m) + 1 + step)[mine], (np.repeat(g[z], m) * 65536 + term)[mine]))
                divide(*(np.concatenate(y) for y in zip(*parts)), depth + 1)

    divide(np.arange(len(key)), place, key, 1)
    return tuple(np.concatenate(x) for x in zip(*found))


def _pair_up(pairs_of):
    """Buckets, sorted by key, are paired some together; the last one waits for its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        enough = GROUP_ROWS

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, enough
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            stop = len(key) if final else int(np.searchsorted(key, key[-1], "left"))
            a, b = pairs_of(t.slice(0, stop)) if stop else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held = t.slice(stop).to_batches()
            rows = len(key) - stop
            enough = max(GROUP_ROWS, 2 * rows)
            if len(a):
                both = np.unique(np.rec.fromarrays([a, b]))  # one pair meets in many tables
                yield pa.RecordBatch.from_arrays([pa.array(both.f0.copy()), pa.array(both.f1.copy())], names=["a", "b"])

        for x in batches:
            if x.num_rows:
                held.append(x)
                rows += x.num_rows
                if rows >= enough:
                    yield from work(False)
        if held:
            yield from work(True)

    return run


def _of_buckets(f: Fraction, likeness: Fraction):
    def pairs_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, rep, n, s1, s2 = (t.column(c).to_numpy() for c in _KEYS.names)
        return pairs_of_buckets(key, rep, n.astype(np.int64), s1, s2, f, likeness)

    return pairs_of


def _of_prefixes(f: Fraction, likeness: Fraction):
    def pairs_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, rep, n, s1, s2, place = (t.column(c).to_numpy() for c in _PREFIX.names[:-1])
        col = t.column("rest").combine_chunks()
        off = np.append(0, np.cumsum(pc.binary_length(col).to_numpy() // 2))
        rest = np.frombuffer(b"".join(col.to_pylist()), np.uint16)
        return pairs_of_prefixes(key, rep, n.astype(np.int64), s1, s2, place.astype(np.int64) >> 1, (place & 1).astype(bool), off, rest, f, likeness)

    return pairs_of


def _prefixes(levels, overfull, f: Fraction, likeness: Fraction):
    """Prefix terms of every set in the order: by level of frequency, and by hash within one.

    ``place`` is twice the place, and one more for open sets. Terms that may be divided bring the
    16-bit hashes of those that follow, as far as common terms are looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep, off, h = _sets(b)
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), n)
            _, _, is_open = _masked(off, h, levels[0].value, overfull.value, f, likeness)
            kind = sum(flagged(x.value, h).astype(np.int8) for x in levels)
            kind[~flagged(levels[0].value, h)] = 0
            o = np.lexsort((h, kind, row))
            place = np.arange(len(h)) - np.repeat(off[:-1], n)  # from 0, in the order
            _, as_larger = prefix_lengths(n, likeness)
            use = np.flatnonzero((kind[o] > 0) & (place < as_larger[row]))
            r = row[use]
            short = mix(h[o]).astype(np.uint16).tobytes()
            to = np.where(kind[o][use] >= DIVIDED, np.minimum(off[1:][r], off[:-1][r] + as_larger[r] + DEPTH - 1), use + 1)
            rest = [short[2 * i + 2 : 2 * j] for i, j in zip(use.tolist(), to.tolist())]
            s1, s2 = parity_sketch(h, off[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[o][use]), pa.array(rep[r]), pa.array(n[r].astype(np.int32)), pa.array(s1[r]), pa.array(s2[r]), pa.array((2 * place[use] + is_open[r]).astype(np.int32)), pa.array(rest, pa.binary())], names=_PREFIX.names
            )

    return run


def candidate_pairs(sets: DataFrame, likeness: Fraction, bucket: int, scratch: Scratch, bits: int = FLAG_BITS) -> tuple[DataFrame, DataFrame]:
    """``(by masks, by prefixes)``, both ``(a, b)``: what live buckets and the refinement propose."""
    f = (1 - likeness) / (1 + likeness)
    sc = sets.sparkSession.sparkContext
    counts = scratch.save(sets.select(F.explode("h").alias("x")).groupBy("x").count().where("count > 1"))
    levels = [sc.broadcast(flag_array(counts.where(F.col("count") > k), bits)) for k in LEVELS]
    full = sets.mapInArrow(_emit(levels[0], None, f, likeness, True), "key long").groupBy("key").count().where(F.col("count") > bucket)
    overfull = sc.broadcast(flag_array(full.select(F.col("key").alias("x")), bits))
    keys = sets.mapInArrow(_emit(levels[0], overfull, f, likeness, False), _KEYS)
    masks = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_pair_up(_of_buckets(f, likeness)), "a long, b long")
    prefix = sets.mapInArrow(_prefixes(levels, overfull, f, likeness), _PREFIX)
    refined = prefix.repartition("key").sortWithinPartitions("key").mapInArrow(_pair_up(_of_prefixes(f, likeness)), "a long, b long")
    return masks, refined


def similar_sets(sets: DataFrame, likeness: Fraction = Fraction(7, 10), bucket: int = BUCKET, scratch: Scratch | None = None, bits: int = FLAG_BITS, masks_only: bool = False) -> DataFrame:
    """``(a, b)`` with a < b: all pairs of ``sets (rep long, h array<long> sorted)`` within likeness.

    ``rep`` must be unique and sets distinct and not empty; equal sets are to be brought in once.
    With ``masks_only`` the refinement of overfull buckets is left out, to measure what the masks
    find alone.
    """
    scratch = scratch or Scratch(sets.sparkSession)
    masks, refined = candidate_pairs(sets, likeness, bucket, scratch, bits)
    cand = scratch.save((masks if masks_only else masks.union(refined)).distinct())
    ids = cand.select(F.col("a").alias("rep")).union(cand.select("b")).distinct()
    some = scratch.save(sets.join(ids, "rep", "left_semi"))
    both = cand.join(some.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a").join(some.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("i") * likeness.denominator >= (F.size("ha") + F.size("hb") - F.col("i")) * likeness.numerator).select("a", "b")


def _classes(rows: DataFrame, terms: Column, row_id: str, likeness: Fraction, bucket: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ids (id), copies (id, rep), pairs (a, b))``: rows of equal sets point to their smallest id,
    and pairs are those of representatives."""
    base = rows.select(F.col(row_id).cast("long").alias("id"), term_hashes(terms).alias("h")).where("id IS NOT NULL AND size(h) > 0")
    base = scratch.save(base.select("id", "h", F.xxhash64("h").alias("k1"), F.xxhash64(F.lit(7), "h").alias("k2")))
    classes = base.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    copies = scratch.save(base.select("id", "k1", "k2").join(classes, ["k1", "k2"]).where("id <> rep").select("id", "rep").distinct())
    sets = base.join(copies, "id", "left_anti").select(F.col("id").alias("rep"), "h")
    return base.select("id"), copies, scratch.save(similar_sets(sets, likeness, bucket, scratch))


def similar_pairs(rows: DataFrame, terms: Column, row_id: str = "id", likeness: Fraction = Fraction(7, 10), bucket: int = BUCKET) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: all pairs of rows whose term sets are alike enough.

    ``terms`` is an array of strings (repeats count once). Rows with no terms, a null array or a
    null id have no partner; a repeated id is one row; rows of equal sets are all paired; likeness
    exactly at the threshold counts; an empty table gives no rows; other columns are not read.
    Terms are compared by 64-bit hashes.
    """
    scratch = Scratch(rows.sparkSession)
    _, copies, pairs = _classes(rows, terms, row_id, likeness, bucket, scratch)
    heads = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(copies.select("rep")).distinct()
    members = scratch.save(copies.select("rep", "id").union(heads.select("rep", F.col("rep").alias("id"))))
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    of_copies = members.join(copies.select("rep").distinct(), "rep", "left_semi")
    left, right = of_copies.select("rep", F.col("id").alias("id_a")), of_copies.select("rep", F.col("id").alias("id_b"))
    return across.union(left.join(right, "rep").where("id_a < id_b").select("id_a", "id_b"))


def similar_groups(rows: DataFrame, terms: Column, row_id: str = "id", likeness: Fraction = Fraction(7, 10), bucket: int = BUCKET) -> DataFrame:
    """``(id, group_id, n_links)``: every row with terms, the smallest id it reaches over pairs
    alike enough, and the number of its partners.

    Copies are counted, never expanded into pairs. Rows are left out and ties treated as in
    :func:`similar_pairs`; a row without partners is its own group.
    """
    scratch = Scratch(rows.sparkSession)
    ids, copies, pairs = _classes(rows, terms, row_id, likeness, bucket, scratch)
    size = copies.groupBy("rep").agg((F.count("*") + 1).alias("m"))
    both = pairs.union(pairs.select("b", "a"))
    links = both.join(size, both.b == size.rep, "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("m", F.lit(1))).alias("others"))
    comp = min_label_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).select(F.col("vertex").alias("rep"), "component")
    out = ids.distinct().join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(size, "rep", "left").join(links, "rep", "left").join(comp, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("m", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))
