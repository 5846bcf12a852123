"""Filling fixed-capacity containers with texts of varying length: vector bin packing.

Every container is limited in three ways at once: tokens, segments and loss-bearing tokens. A
container is filled by the dot-product heuristic: of the pieces that still fit, the one whose
demand vector has the largest product with the container's remaining capacities goes in, so what
is scarce in it is weighed most. Pieces are kept by size and, within a size, by loss; of a size
only the largest loss that fits can win, and as loss never exceeds tokens, sizes are looked at
from the largest that fits downwards until none below can win. So the choice is exact and yet no
scan of all pieces.

Partitions pack their own documents; no text moves for that. What lies in containers that are not
nearly full is carried on from chunk to chunk within a partition, and what a partition has left
at its end, a few containers, is packed again together with the others' rests.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.session import Scratch, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("container_id", T.LongType()), ("segment_no", T.IntegerType()), ("doc_id", T.LongType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()), ("n_tokens", T.IntegerType()), ("n_loss", T.IntegerType()), ("text", T.StringType()), ("closed_by", T.StringType()))]
)
_OPEN_SCHEMA = T.StructType([*SCHEMA.fields, T.StructField("is_open", T.BooleanType())])


@dataclass(frozen=True)
class Limits:
    """What a container holds at most. With ``loss`` below ``tokens`` a text of more loss-bearing
    tokens than that is cut like one that is too long."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, enc, limit: int) -> Iterator[tuple[int, int, int]]:
    """``(start_char, end_char, n_tokens)``: the whole text, or cuts of at most ``limit`` tokens
    if it alone is longer. Cuts lie between characters."""
    toks = enc.encode_ordinary(text)
    if len(toks) <= limit:
        if toks:
            yield 0, len(text), len(toks)
        return
    at, char = 0, 0
    while at < len(toks):
        end = min(at + limit, len(toks))
        while True:
            raw = b"".join(enc.decode_single_token_bytes(t) for t in toks[at:end])
            try:
                body = raw.decode()
                break
            except UnicodeDecodeError:
                end -= 1  # a character reaches over the cut
        yield char, char + len(body), end - at
        char += len(body)
        at = end


_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_INK = re.compile(r"\S")


def prompt_tokens(text: str, enc) -> int:
    """Tokens of a text that bear no loss: its first paragraph, if others follow."""
    start = _INK.search(text)
    m = _BLANK.search(text, start.start()) if start else None
    return len(enc.encode_ordinary(text[: m.end()])) if m and m.end() < len(text) else 0


def segments_of(text: str, enc, limits: Limits) -> Iterator[tuple[int, int, int, int]]:
    """``(start_char, end_char, n_tokens, n_loss)`` of the text's pieces.

    A text is cut only if it alone is beyond a limit.
    """
    prompt = prompt_tokens(text, enc)
    whole = list(pieces(text, enc, limits.tokens))
    if sum(n for _, _, n in whole) - prompt > limits.loss:
        whole = list(pieces(text, enc, min(limits.tokens, limits.loss)))
    for start, end, n in whole:
        mine = min(prompt, n)
        prompt -= mine
        yield start, end, n, n - mine


class Packer:
    """Pieces waiting by token count; ``fill`` takes the contents of one container."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.sizes: list[int] = []
        self.by_size: dict[int, list[tuple[int, int, object]]] = {}  # loss, running number, piece
        self.tokens = self.number = 0

    def add(self, tokens: int, loss: int, piece: object) -> None:
        self.number += 1
        held = self.by_size.get(tokens)
        if held is None:
            self.by_size[tokens] = [(loss, self.number, piece)]
            insort(self.sizes, tokens)
        else:
            insort(held, (loss, self.number, piece))
        self.tokens += tokens

    def _take(self, at: int, k: int) -> tuple[int, int, object]:
        size = self.sizes[at]
        held = self.by_size[size]
        loss, _, piece = held.pop(k)
        if not held:
            del self.by_size[size]
            del self.sizes[at]
        self.tokens -= size
        return size, loss, piece

    def choose(self, rt: int, rs: int, rl: int) -> tuple[int, int] | None:
        """Place of the waiting piece of the largest dot product with what is left."""
        lim = self.limits
        at_token, at_loss = rt / lim.tokens**2, rl / lim.loss**2
        best, choice = -1.0, None
        for at in range(bisect_right(self.sizes, rt) - 1, -1, -1):
            size = self.sizes[at]
            if size * at_token + min(size, rl) * at_loss <= best:
                break  # nor can any smaller size win
            held = self.by_size[size]
            k = bisect_left(held, (rl + 1,)) - 1
            if k >= 0 and (dot := size * at_token + held[k][0] * at_loss) > best:
                best, choice = dot, (at, k)
        return choice  # a segment weighs the same for every piece

    def fill(self) -> tuple[list[tuple[int, int, object]], int, str]:
        """Contents of the next container, its used tokens and what closed it: ``tokens``,
        ``segments`` or ``loss`` that were used up for all that waits, or the ``end`` of pieces."""
        lim = self.limits
        rt, rs, rl = lim.tokens, lim.segments, lim.loss
        out = []
        while rs and self.sizes:
            choice = self.choose(rt, rs, rl)
            if choice is None:
                break
            size, loss, piece = self._take(*choice)
            out.append((size, loss, piece))
            rt, rs, rl = rt - size, rs - 1, rl - loss
        why = "end" if not self.sizes else "segments" if not rs and self.sizes[0] <= rt else "loss" if self.sizes[0] <= rt else "tokens"
        return out, lim.tokens - rt, why


def _rows(packed: list[tuple[int, list, str, bool]], with_open: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(10)]
    for cid, content, why, is_open in packed:
        for no, (size, loss, (doc, start, end, text)) in enumerate(content, 1):
            for c, v in zip(cols, (cid, no, doc, start, end, size, loss, text, why, is_open)):
                c.append(v)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    n = 10 if with_open else 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], names=_OPEN_SCHEMA.names[:n])


def _pack_documents(vocabulary: str, limits: Limits, full: float, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 32
        made = 0
        packer = Packer(limits)
        held = 0

        def drain(final: bool) -> pa.RecordBatch:
            nonlocal made, held
            packed, rest = [], []
            while packer.sizes:
                content, used, why = packer.fill()
                # no other piece can do better where segments or loss are used up
                if used >= full * limits.tokens or why in ("segments", "loss"):
                    packed.append((base + made, content, why, False))
                    made += 1
                else:
                    rest.append((content, why))
            for content, why in rest:
                if final:
                    packed.append((base + made, content, why, True))
                    made += 1
                else:
                    for size, loss, piece in content:
                        packer.add(size, loss, piece)
            held = 0
            return _rows(packed, True)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                for start, end, n, loss in segments_of(text, enc, limits):
                    packer.add(n, loss, (doc, start, end, text if end - start == len(text) else text[start:end]))
                held += len(text)
                if held >= chunk_chars:
                    yield drain(False)
        yield drain(True)

    return run


def _pack_rests(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)
        base = (1 << 60) + (TaskContext.get().partitionId() << 32)
        for b in batches:
            for doc, start, end, n, loss, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start_char", "end_char", "n_tokens", "n_loss", "text"))):
                packer.add(n, loss, (doc, start, end, text))
        packed = []
        while packer.sizes:
            content, _, why = packer.fill()
            packed.append((base + len(packed), content, why, False))
        yield _rows(packed, False)

    return run


def packed_containers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), vocabulary: str = VOCABULARY, full: float = 0.998, chunk_chars: int = 24_000_000, fan_in: int = 64) -> DataFrame:
    """``(container_id, segment_no, doc_id, start_char, end_char, n_tokens, n_loss, text,
    closed_by)``.

    One row per segment; a container's segments never exceed ``limits``. A text is cut only if it
    alone is beyond a limit; its pieces then cover it in order. The first paragraph of a text of
    several is its prompt, which bears no loss. ``closed_by`` tells what kept further pieces out. Null and empty texts
    need no place; texts of any length are packed whole; repeated rows are placed as often as they
    occur; a null id stays null; an empty table gives no containers; other columns are not read.
    ``full`` is the share of tokens from which a container counts as finished in its partition.
    """
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''"))
    first = Scratch(docs.sparkSession).save(rows.mapInArrow(_pack_documents(vocabulary, limits, full, chunk_chars), _OPEN_SCHEMA))
    parts = rows.rdd.getNumPartitions()
    rests = first.where("is_open").drop("is_open").repartition(max(1, parts // fan_in)).mapInArrow(_pack_rests(limits), SCHEMA)
    return first.where("NOT is_open").drop("is_open").unionByName(rests)
