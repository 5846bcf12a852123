"""Evaluation passages inside training text, found by suffix arrays over the training text.

Each shard of documents becomes one array of word numbers. Words that occur in no test item end
every possible match, so the shard's suffix array holds only the suffixes whose first
``min_words`` words all occur in some item; no match can be lost by that. Every suffix of every
item is then binary-searched in it, and each hit is extended word by word to its longest verbatim
match. Documents stay where they are: nothing is shuffled but the few hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.session import spread

WORD = re.compile(r"[^\W_]+")
SHARD_WORDS = 4_000_000
BLOCK_WORDS = 200_000  # about 25 MB in each worker
SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("item_word", T.IntegerType())])


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, lower-cased."""
    return WORD.findall(text.lower())


def run_lengths(a: np.ndarray) -> np.ndarray:
    """For each place, how many non-zero values stand from here on without a break."""
    n = len(a)
    stops = np.flatnonzero(a == 0)
    nxt = np.append(stops, n)[np.searchsorted(stops, np.arange(n))]
    return nxt - np.arange(n)


def sparse_suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes with ``depth`` words before the next break, sorted by these words."""
    starts = np.flatnonzero(run_lengths(a) >= depth)
    if not len(starts):
        return starts
    return starts[np.lexsort([a[starts + k] for k in range(depth - 1, -1, -1)])]


def _less(a: np.ndarray, at: np.ndarray, q: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether the suffixes of ``a`` at ``at`` are smaller than the rows of ``q``."""
    s = a[at[:, None] + np.arange(q.shape[1])]
    differs = s != q
    first = differs.argmax(1)
    rows = np.arange(len(q))
    lt = s[rows, first] < q[rows, first]
    return np.where(differs.any(1), lt, or_equal)


def search(a: np.ndarray, sa: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range in ``sa`` of the suffixes that begin with each row of ``q``; all rows at once."""
    out = []
    for or_equal in (False, True):
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            k = np.flatnonzero(open_)
            below = _less(a, sa[mid[k]], q[k], or_equal)
            lo[k] = np.where(below, mid[k] + 1, lo[k])
            hi[k] = np.where(below, hi[k], mid[k])
        out.append(lo)
    return out[0], out[1]


class ItemBlock:
    """A block of test items as one word array with breaks, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        ids, starts, seq = [], [], [0]
        for item_id, text in items:
            ids.append(item_id)
            starts.append(len(seq))
            seq += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)] + [0]
        self.ids, self.starts, self.seq = np.array(ids, np.int64), np.array(starts, np.int64), np.array(seq, np.int64)
        self.suffixes = np.flatnonzero(run_lengths(self.seq) >= min_words)
        self.query = self.seq[self.suffixes[:, None] + np.arange(min_words)] if len(self.suffixes) else np.zeros((0, min_words), np.int64)
        # equal beginnings are searched once
        self.query, self.of = np.unique(self.query, axis=0, return_inverse=True)
        self.of = self.of.reshape(-1)

    def numbers(self, text: str) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in words(text)]

    def find(self, a: np.ndarray, doc_starts: np.ndarray) -> dict[str, np.ndarray]:
        """Longest match for every document and item in a shard's word array ``a``."""
        sa = sparse_suffix_array(a, self.min_words)
        lo, hi = search(a, sa, self.query) if len(sa) and len(self.query) else (np.zeros(len(self.query), np.int64),) * 2
        n = (hi - lo)[self.of]
        hit = np.flatnonzero(n)
        n = n[hit]
        item_at = np.repeat(self.suffixes[hit], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc_at = sa[np.repeat(lo[self.of[hit]], n) + within] if len(hit) else np.zeros(0, np.int64)
        # a hit whose predecessors agree as well is the tail of a longer one
        head = (a[doc_at - 1] != self.seq[item_at - 1]) | (a[doc_at - 1] == 0)
        doc_at, item_at = doc_at[head], item_at[head]
        length = np.full(len(doc_at), self.min_words, np.int64)
        grow = np.arange(len(doc_at))
        while len(grow):
            x, y = a[doc_at[grow] + length[grow]], self.seq[item_at[grow] + length[grow]]
            grow = grow[(x == y) & (x != 0)]
            length[grow] += 1
        doc, item = np.searchsorted(doc_starts, doc_at, "right") - 1, np.searchsorted(self.starts, item_at, "right") - 1
        order = np.lexsort([item_at, doc_at, -length, item, doc])
        if len(order):
            d, i = doc[order], item[order]
            order = order[np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]))]
        return {"doc": doc[order], "item_id": self.ids[item[order]] if len(order) else np.zeros(0, np.int64), "n_words": length[order], "doc_word": doc_at[order] - doc_starts[doc[order]], "item_word": item_at[order] - self.starts[item[order]]}


def _scan(shared, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        ids: list[int] = []
        starts: list[int] = []
        parts: list[np.ndarray] = [np.zeros(1, np.int32)]
        size = 1

        def flush() -> pa.RecordBatch:
            a = np.concatenate(parts)
            f = block.find(a, np.array(starts, np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, object)[f["doc"]].tolist(), pa.int64()), pa.array(f["item_id"]), *(pa.array(f[c].astype(np.int32)) for c in ("n_words", "doc_word", "item_word"))], names=SPANS.names
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                nums = block.numbers(text)
                if len(nums) < block.min_words:
                    continue
                ids.append(doc_id)
                starts.append(size)
                parts.append(np.array(nums + [0], np.int32))
                size += len(nums) + 1
                if size >= shard_words:
                    yield flush()
                    ids, starts, parts, size = [], [], [np.zeros(1, np.int32)], 1
        if ids:
            yield flush()

    return run


def item_blocks(items: DataFrame, item_id: str, text: str, min_words: int, block_words: int) -> Iterator[ItemBlock]:
    """The query set in blocks of bounded size, read one after the other."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t) // 2 + 1  # at most so many words
        if size >= block_words:
            yield ItemBlock(held, min_words)
            held, size = [], 0
    if held:
        yield ItemBlock(held, min_words)


def leaked_spans(docs: DataFrame, items: DataFrame, min_words: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, item_id, n_words, doc_word, item_word)``: the longest verbatim match of every
    document and item that share ``min_words`` consecutive words; positions count words from 0.

    Items are a stated query set and are searched in blocks of ``block_words``, each against all
    documents. Of matches of equal length the first in the document counts. Null and empty texts
    and items shorter than ``min_words`` match nothing; texts of any length are searched whole;
    repeated document rows come out as often as they occur; null item ids are left out; empty
    tables give no rows; other columns are not read.
    """
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    out = None
    for block in item_blocks(items, item_id, item_text, min_words, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_words
        found = rows.mapInArrow(_scan(shared, shard_words), SPANS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SPANS)


def without_leaks(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The documents that hold no passage of any item, with all their columns."""
    spans = leaked_spans(docs, items, **kw).select(F.col("doc_id").alias("__leaked"))
    key = kw.get("doc_id", "doc_id")
    return docs.join(spans.distinct(), docs[key].cast("long") == F.col("__leaked"), "left_anti")
