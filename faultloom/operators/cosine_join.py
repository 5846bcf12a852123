"""All pairs of sparse vectors at a cosine threshold, without a table of candidates.

Terms are numbered by falling frequency, so a row of terms and counts packs into about two bytes
a term and whole vectors can travel with their index entries. A vector enters the index under its
rarest terms, up to where the rest has a norm below the threshold. Rows that meet under a term are
compared on the spot: what two vectors share lies at their rarest common term or beyond, so only
there a pair is counted, and nothing has to be made distinct or joined again.

Before the exact product three bounds by Cauchy-Schwarz apply: norms from the term on (a range of
the rows sorted by it), the term's own product plus the norms beyond it, and norms by groups of
terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VECTORS = "id long, norm double, v binary, own boolean"
ENTRIES = "term int, id long, norm double, v binary"
PAIRS = "a long, b long, cosine double"
ROWS_AT_ONCE = 8192
PAIRS_AT_ONCE = 1 << 18
BOUNDS_AT_ONCE = 1 << 15
GROUPS = 32
SKETCH = 256


def _segments(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every element of the ranges ``starts .. starts + counts``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def pack(n: int, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.Array:
    """One binary a row: the number of terms, their differences with a mark of counts other than
    one, then these counts. Rows ascend, and so do the terms of a row."""
    k = np.bincount(row, minlength=n)
    first = np.cumsum(k) - k
    step = np.diff(term, prepend=0)
    step[first[k > 0]] = term[first[k > 0]]
    other = tf != 1
    size = 1 + k + np.bincount(row[other], minlength=n)
    at = np.cumsum(size) - size
    values = np.empty(int(size.sum()), np.int64)
    values[at] = k
    values[at[row] + 1 + np.arange(len(row)) - first[row]] = step << 1 | other
    late = row[other]
    values[at[late] + 1 + k[late] + np.arange(len(late)) - np.searchsorted(late, late)] = tf[other].astype(np.int32).view(np.uint32)
    width = 1 + sum((values >= 1 << 7 * j).astype(np.int64) for j in range(1, 5))
    end = np.cumsum(width)
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for j in range(5):
        m = width > j
        data[(end - width)[m] + j] = values[m] >> 7 * j & 127 | (width[m] > j + 1) * 128
    offsets = np.append(0, end[at + size - 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, tf)`` of what :func:`pack` made."""
    offsets = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
    data = np.frombuffer(v.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    last = data < 128
    end = np.flatnonzero(last) + 1
    start = np.append(0, end[:-1])[: len(end)]
    values = np.zeros(len(end), np.int64)
    for j in range(5):
        m = end - start > j
        values[m] |= (data[start[m] + j] & 127).astype(np.int64) << 7 * j
    at = np.append(0, np.cumsum(last))[offsets - offsets[0]]
    k = values[at[:-1]]
    place = np.arange(len(values)) - np.repeat(at[:-1], np.diff(at))
    upto = np.repeat(k, np.diff(at))
    x = values[(place > 0) & (place <= upto)]
    row = np.repeat(np.arange(len(v)), k)
    total = np.cumsum(x >> 1)
    term = total - np.append(0, total)[(np.cumsum(k) - k)[row]]
    tf = np.ones(len(x), np.int64)
    tf[(x & 1) == 1] = values[place > upto].astype(np.uint32).view(np.int32)
    return row, term, tf


class Idf:
    """idf by term number. Numbers ascend as frequency falls, so it is a step function."""

    def __init__(self, n: int, levels: list[tuple[int, int]]):
        levels = sorted(levels, reverse=True)
        self.starts = np.cumsum([0] + [c for _, c in levels])[:-1]
        self.steps = np.log((1.0 + n) / (1.0 + np.array([d for d, _ in levels], np.float64))) + 1
        self.single = float(np.log((1.0 + n) / 2.0) + 1)

    def of(self, term: np.ndarray) -> np.ndarray:
        return self.steps[np.searchsorted(self.starts, term, "right") - 1]


def numbered(terms: pa.Array):
    """``(id, e)`` to ``(id, term, tf, rare)``: numbers of the terms in the list, the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(1)
            off = e.offsets.to_numpy()
            each = e.values.slice(off[0], off[-1] - off[0])
            term, tf = each.field(0), pc.fill_null(each.field(1), 0)
            known = pc.index_in(term, value_set=terms)
            hit = pc.is_valid(known).to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(hit))[off - off[0]]
            rest = off - off[0] - upto
            lists = lambda o, x: pa.ListArray.from_arrays(pa.array(o, pa.int32()), x)
            miss = pa.array(~hit)
            rare = pa.StructArray.from_arrays([term.filter(miss).cast(pa.string()), tf.filter(miss).cast(pa.int32())], ["term", "tf"])
            hit = pa.array(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(upto, known.filter(hit).cast(pa.int32())), lists(upto, tf.filter(hit).cast(pa.int32())), lists(rest, rare)], names=["id", "term", "tf", "rare"])

    return run


def _lists(c: pa.Array) -> tuple[np.ndarray, pa.Array]:
    c = c if not c.null_count else pc.if_else(pc.is_valid(c), c, pa.scalar([], c.type))
    off = c.offsets.to_numpy()
    return np.repeat(np.arange(len(c)), np.diff(off)), c.values.slice(off[0], off[-1] - off[0])


def packed(idf: Idf):
    """``(id, term, tf, more, single)`` to ``(id, norm, v, own)``. Equal rows of shared terms are equal
    here; ``own`` tells that a row has terms of its own besides, which only its norm shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term = _lists(b.column("term"))
            tf = _lists(b.column("tf"))[1]
            late, more = _lists(b.column("more"))
            row = np.append(row, late)
            term = np.append(term.to_numpy(), more.field(0).to_numpy()).astype(np.int64)
            tf = np.append(tf.to_numpy(), more.field(1).to_numpy()).astype(np.int64)
            o = np.lexsort((tf, term, row))
            row, term, tf = row[o], term[o], tf[o]
            single = pc.fill_null(b.column("single"), 0.0).to_numpy(zero_copy_only=False)
            norm = np.sqrt(np.bincount(row, (tf * idf.of(term)) ** 2, b.num_rows) + single * idf.single**2)
            if len(row):  # a term that a repeated id holds twice
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])))
                row, term, tf = row[new], term[new], np.add.reduceat(tf, new)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(norm), pack(b.num_rows, row, term, tf), pa.array(single > 0)], names=["id", "norm", "v", "own"])

    return run


def entries(idf: Idf, threshold: float):
    """``(id, norm, v)`` to index entries, each with its whole vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            norm, v = b.column("norm").to_numpy(), b.column("v")
            row, term, tf = unpack(v)
            ok = norm[row] > 0
            row, term, tf = row[ok], term[ok], tf[ok]
            w = tf * idf.of(term) / norm[row]
            total = np.cumsum(w * w)
            k = np.bincount(row, minlength=b.num_rows)
            rest = total - np.append(0, total)[(np.cumsum(k) - k)[row]]
            keep = rest >= threshold * threshold * (1 - 1e-9)  # slightly below, so rounding loses nothing
            at = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(term[keep], pa.int32()), b.column("id").take(pa.array(at)), pa.array(norm[at]), v.take(pa.array(at))], names=["term", "id", "norm", "v"])

    return run


def _found(key: np.ndarray, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``(row, term)`` stand among the sorted keys, and whether they do."""
    want = row << 32 | term
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return at, key[at] == want


def _pairs(x: pa.Table, idf: Idf, t: float, across: int = 0) -> Iterator[pa.RecordBatch]:
    """Pairs of rows whose rarest common term is the one they meet under; if ``across``, only those
    of one row before that place and one from there on."""
    own, ids, norm = x.column("term").to_numpy().astype(np.int64), x.column("id").to_numpy(), x.column("norm").to_numpy()
    row, term, tf = unpack(pa.concat_arrays(x.column("v").chunks))
    w = tf * idf.of(term) / norm[row]
    n = len(own)
    tail = np.sqrt(np.bincount(row, np.where(term <= own[row], w * w, 0.0), n))
    o = np.lexsort((-tail, own))
    own, ids, tail, left = own[o], ids[o], tail[o], o < across
    place = np.empty(n, np.int64)
    place[o] = np.arange(n)
    row = place[row]
    o = np.argsort(row, kind="stable")
    row, term, w = row[o], term[o], w[o]
    del tf, norm
    key = row << 32 | term
    begin = np.searchsorted(row, np.arange(n + 1))
    here = np.flatnonzero(term == own[row])  # one a row
    middle, mine = here + 1, w[here]
    beyond = np.sqrt(np.maximum(tail * tail - mine * mine, 0.0))
    group = np.cumsum(np.append(False, own[1:] != own[:-1]))
    least = (t - 1e-7) / tail
    until = np.searchsorted(group * 4 + (2 - np.minimum(tail, 1.9)), group * 4 + (2 - least), "right")
    count = np.maximum(until - np.arange(1, n + 1), 0)
    rare = term > own[row]
    norms = np.sqrt(np.bincount(row[~rare] * GROUPS + term[~rare] % GROUPS, w[~rare] ** 2, n * GROUPS)).reshape(n, GROUPS).astype(np.float32)
    bits = np.zeros((n, SKETCH), bool)
    bits[row[rare], (term[rare] * 2654435761 >> 12) % SKETCH] = True
    sketch = np.packbits(bits, axis=1).view(np.uint64)
    del bits, rare
    total = np.cumsum(count)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        a, b = _segments(np.arange(start + 1, stop + 1), count[start:stop])
        a += start
        start = stop
        ok = mine[a] * mine[b] + beyond[a] * beyond[b] >= t - 1e-7
        if across:
            ok &= left[a] != left[b]
        a, b = a[ok], b[ok]
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), BOUNDS_AT_ONCE):
            x, y = a[i : i + BOUNDS_AT_ONCE], b[i : i + BOUNDS_AT_ONCE]
            ok[i : i + BOUNDS_AT_ONCE] = np.einsum("ij,ij->i", norms[x], norms[y]) >= t - 1e-5
        a, b = a[ok], b[ok]
        for i in range(0, len(a), BOUNDS_AT_ONCE):
            x, y = a[i : i + BOUNDS_AT_ONCE], b[i : i + BOUNDS_AT_ONCE]
            alike = np.flatnonzero((sketch[x] & sketch[y]).any(axis=1))
            pair, at = _segments(middle[x[alike]], begin[x[alike] + 1] - middle[x[alike]])
            hit = _found(key, y[alike[pair]], term[at])[1]
            first = np.ones(len(x), bool)
            first[alike[pair[hit]]] = False  # met under a rarer term
            x, y = x[first], y[first]
            pair, at = _segments(begin[x], middle[x] - begin[x])
            to, hit = _found(key, y[pair], term[at])
            cosine = np.bincount(pair[hit], w[at[hit]] * w[to[hit]], len(x))
            ok = cosine >= t - 1e-12
            p, q = ids[x[ok]], ids[y[ok]]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(cosine[ok])], names=["a", "b", "cosine"])


def compare(idf: Idf, threshold: float):
    """Index entries, sorted by term, to pairs. A term's rows are held together, unpacked by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(x: pa.Table) -> Iterator[pa.RecordBatch]:
            term = x.column("term").to_numpy()
            new = np.append(True, term[1:] != term[:-1])
            alone = new & np.append(new[1:], True)  # under its term a row meets nobody
            x = x.filter(pa.array(~alone))
            ends = np.append(np.flatnonzero(new[~alone])[1:], x.num_rows)
            start = 0
            while start < x.num_rows:
                end = int(ends[max(np.searchsorted(ends, start + ROWS_AT_ONCE, "right") - 1, np.searchsorted(ends, start, "right"))])
                if end - start <= ROWS_AT_ONCE:
                    yield from _pairs(x.slice(start, end - start), idf, threshold)
                else:  # one frequent term: its rows meet by blocks
                    parts = [x.slice(i, min(ROWS_AT_ONCE, end - i)) for i in range(start, end, ROWS_AT_ONCE)]
                    for i, p in enumerate(parts):
                        yield from _pairs(p, idf, threshold)
                        for q in parts[:i]:
                            yield from _pairs(pa.concat_tables([p, q]), idf, threshold, p.num_rows)
                start = end

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            last = b.column("term")[-1].as_py()
            if rows >= ROWS_AT_ONCE and held[0].column("term")[0].as_py() != last:
                x = pa.Table.from_batches(held)
                cut = int(np.searchsorted(x.column("term").to_numpy(), last))
                yield from done(x.slice(0, cut))
                held = x.slice(cut).to_batches()
                rows = x.num_rows - cut
        if held:
            yield from done(pa.Table.from_batches(held))

    return run
