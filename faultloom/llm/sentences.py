"""Sentence units across languages and scripts by a hidden-event n-gram language model.

Layout decides first: blocks end at blank lines, list items and headings; lines of logs and of
fenced blocks are units. Within a block the text is a sequence of words, and after every word
that may close a sentence a boundary token may stand hidden. An n-gram model over words and
boundaries is trained by expectation-maximisation on unlabelled text: block ends and starts are
seen boundaries, the others get posteriors by the forward-backward procedure, round after round.
The same posteriors then decide each possible boundary. Abbreviations, initials, ordinals and
ellipses need no lists: what follows them, and whether a block ever ends with them, tells.
Marks that may close a sentence are those of Unicode's Sentence_Terminal, in any script.

Text without any such mark, in a script written without spaces, has a hidden event after every
character or, where it is spaced, at every space. A second model of the same kind, learnt from
punctuated text with its marks taken out, decides there by its posteriors.

Text inside quotation marks or brackets is one word to the model, so it is never divided. In
scripts without spaces every character is a word. Thai, which has no full stop, has its boundary
at a space between Thai letters.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.session import Scratch, spread

try:
    import regex
except ImportError:  # the marks named below remain
    regex = None

SAMPLE_DOCS = 6000
ROUNDS = 5
SIGHTED = 700_000  # words; of longer texts sightings are weighed as expected in so many
RARE = 3e-5
COMMON = 1e-3
VARIETY = 0.12
ROW_TOKENS = 1 << 18
HELD = 200_000  # keys a task counts before it hands them on
ONE = 1 << 30  # probabilities are summed as integers, so sums are the same in any order
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sent_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])

_SOLID = "々-〇぀-ヿ㐀-䶿一-鿿ｦ-ﾟ"  # scripts written without spaces
_SPACED = "຀-໿ក-៿က-႟"  # Lao, Khmer, Burmese: spaces stand between phrases only
_WIDE = "。！？｡។៕။።፧፨"  # marks that need no space after them
_STOP = ".!?…؟۔।॥" + _WIDE
if regex is not None:  # the whole property Sentence_Terminal, from the library's own tables
    _STOP += "".join(c for c in regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, range(0x80, 0x20000)))) if c not in _STOP and c != "．")
_PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‹": "›", "【": "】", "《": "》"}
_OPEN = "".join(re.escape(c) for c in _PAIRS)
_THAI = "ก-๎"
_TOKEN = re.compile(rf"[^\s{_SOLID}{_WIDE}…{_OPEN}]+…*|[{_SOLID}]|[{_WIDE}…]+|[{_OPEN}]")
_PARTS = re.compile(rf"({_TOKEN.pattern})(\s*)")  # every character of a block is in one
_PART = re.compile(rf"(?:{_TOKEN.pattern})\s*")
_LINE = re.compile(r"\S(?:[^\n]*\S)?")  # a line without surrounding white space
_FENCE = re.compile(r"[ \t]{0,3}(```|~~~)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+")
_BRACKETS = "（([【"
B = "<b>"


def spans(text: str, start: int, end: int) -> dict[int, int]:
    """Outermost quoted or bracketed stretches of a block: opening place to place after the end."""
    out: dict[int, int] = {}
    at = start
    find = _OPENER.search
    while m := find(text, at, end):
        i = m.start()
        c = text[i]
        close = _PAIRS[c]
        if c in _BRACKETS:
            depth, j = 0, i
            while j < end:
                if text[j] == c:
                    depth += 1
                elif text[j] == close:
                    depth -= 1
                    if not depth:
                        break
                j += 1
        else:
            j = min((k for k in (text.find(x, i + 1, end) for x in close) if k >= 0), default=end)
        if j < end:
            out[i] = at = j + 1
        else:
            at = i + 1  # never closed: an ordinary character
    return out


_OPENER = re.compile(f"[{_OPEN}]")
_DIGITS = re.compile(r"\d+")
_SHAPES = ((re.compile(r"[a-zß-öø-ÿа-џ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-ÞЀ-Я]+"), "X"), (re.compile(r"[^\W\dxX_]+"), "o"))


def shape(word: str) -> str:
    if word.isascii():  # most words are letters and perhaps a mark
        body = word if word[-1:].isalpha() else word[:-1]
        if body.isalpha():
            if body.islower():
                return "x" + word[len(body) :]
            if body[0].isupper() and body[1:].islower():
                return "Xx" + word[len(body) :]
    for p, to in _SHAPES:
        word = p.sub(to, word)
    return word[:8]


_LAST_THAI, _CLOSING = 1, 2
_words: dict[str, tuple[str, int]] = {}  # what a word alone tells


def _word(x: str) -> tuple[str, int]:
    got = _words.get(x)
    if got is None:
        if len(_words) > 200_000:
            _words.clear()
        closing = x.rstrip("\"'”’»)]")[-1:] in _STOP if x[-1] in "\"'”’»)]" else x[-1] in _STOP
        got = _words[x] = _DIGITS.sub("0", x), _CLOSING * closing + _LAST_THAI * ("ก" <= x[-1] <= "๎")
    return got


def _gap(text: str, w: str, i: int, j: int, end: int, closing: bool) -> int:
    after = text[j : j + 1] if j < end else " "
    spaced = after.isspace()
    if closing and (spaced or w[-1] in _WIDE or w[0] == "<" or (w[-1] == "…" and _GOES_ON.match(after))):
        return 1 if w[0] != "<" or spaced or text[j - 1] in "」』）”】" else 0
    if spaced and j < end and "ก" <= text[j - 1] <= "๎":
        n = _SPACE.match(text, j, end)
        k = n.end() if n else j
        if k < end and "ก" <= text[k] <= "๎":
            return 2
    return 0


_GOES_ON = re.compile(f"[{_SOLID}{_OPEN}]")
_SPACE = re.compile(r"\s+")


def tokens(text: str, start: int, end: int) -> tuple[list[str], list[int], list[int], list[int]]:
    """Words of a block with their places and the kind of gap after each.

    Kinds: 0 never a boundary, 1 a boundary may be hidden here, 2 a boundary is certain.
    """
    inner = spans(text, start, end)
    if not inner:
        while start < end and text[start].isspace():
            start += 1
        parts = _PARTS.findall(text, start, end)
        get = _words.get
        told = [get(x) or _word(x) for x, _ in parts]
        begins = list(accumulate([len(x) + len(y) for x, y in parts], initial=start))
        begins.pop()
        ends = [i + len(x) for i, (x, _) in zip(begins, parts)]
        gaps = [0] * len(parts)
        for k in [k for k, (_, tells) in enumerate(told) if tells]:
            w, tells = told[k]
            gaps[k] = _gap(text, w, begins[k], ends[k], end, tells >= _CLOSING)
        return [w for w, _ in told], begins, ends, gaps
    words: list[str] = []
    begins = []
    ends = []
    gaps = []
    at = start
    while at < end:
        for m in _TOKEN.finditer(text, at, end):
            i, j = m.span()
            if i in inner:
                j = inner[i]
                body = text[i + 1 : j - 1].rstrip()
                w = ("<r" if text[i] in _BRACKETS else "<q") + ("." if body[-1:] in _STOP and body else "") + (":" if i > start and text[i - 1].isspace() else "") + ">"
                gap = _gap(text, w, i, j, end, "." in w)
            else:
                w, tells = _word(m[0])
                gap = _gap(text, w, i, j, end, tells >= _CLOSING) if tells else 0
            words.append(w)
            begins.append(i)
            ends.append(j)
            gaps.append(gap)
            if j > m.end():
                break  # go on behind the stretch
        else:
            break
        at = j
    return words, begins, ends, gaps


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, is_line)``: blocks of prose, and single lines of fenced parts."""
    at, n, fenced = 0, len(text), False
    start = stop = -1
    while at < n:
        e = text.find("\n", at)
        e = n if e < 0 else e
        if not fenced and text[at : at + 1].isalpha():  # most lines: they go on or begin a block
            start, stop = (at if start < 0 else start), e
        elif _FENCE.match(text, at, e):
            if start >= 0:
                yield start, stop, False
                start = -1
            fenced = not fenced
        elif fenced:
            if not text[at:e].isspace() and e > at:
                yield at, e, True
        elif e == at or text[at:e].isspace():
            if start >= 0:
                yield start, stop, False
                start = -1
        elif m := _HEADING.match(text, at, e):
            if start >= 0:
                yield start, stop, False
                start = -1
            yield m.end(), e, False
        elif m := _ITEM.match(text, at, e):
            if start >= 0:
                yield start, stop, False
            start, stop = m.end(), e
        else:
            start, stop = (at if start < 0 else start), e
        at = e + 1
    if start >= 0:
        yield start, stop, False


_ONE_SOLID = re.compile(f"[{_SOLID}]")
_LETTERED = re.compile(f"[{_SPACED}]")


def plain_gaps(words: list[str], gaps: list[int]) -> list[int] | None:
    """Gaps of a block without any mark that may end a sentence: every place where an event may be
    hidden, if most of it is in a script without spaces or with spaces between phrases only."""
    if len(words) < 2 or any(gaps[:-1]) or gaps[-1] == 1:
        return None
    if not solid(words) and sum(1 for w in words if _LETTERED.match(w)) <= 0.6 * len(words):
        return None
    return [1] * len(words)


class EventModel:
    """Interpolated (Witten-Bell) trigram over words and hidden boundaries.

    Block ends are a sample of all boundaries: of every word that does end sentences about the
    same share ``rho`` of its boundaries falls on a block end, of an abbreviation none. So the
    boundary's own probability comes from seen events, P(<b> | u v) = ends(u v) / rho / n(u v),
    as does what may follow it, from block starts. What follows a word without a boundary is
    learnt by expectation-maximisation, with these two held fixed; left free, a model over few
    sentence patterns would rather memorise their sequences than see boundaries.
    """

    def __init__(self, vocab: set[str]):
        self.vocab = vocab
        self.shapes: dict[str, str] = {}
        self.uni: Counter = Counter()
        self.total = 1.0
        self.bi: dict = {}
        self.tri: dict = {}
        self.end2: dict = {}
        self.end3: dict = {}
        self.base: float | None = None  # of a boundary after any word, in text without marks
        self.plain: EventModel | None = None
        self.memo: dict = {}

    def state(self) -> tuple:
        return self.vocab, dict(self.uni), self.total, self.bi, self.tri, self.end2, self.end3, self.base, self.plain and self.plain.state()

    @staticmethod
    def of(state: tuple) -> EventModel:
        m = EventModel(state[0])
        m.uni, m.total, m.bi, m.tri, m.end2, m.end3, m.base = state[1:8]
        m.plain = EventModel.of(state[8]) if state[8] else None
        return m

    def norm(self, w: str) -> str:
        if w in self.vocab or w[0] == "<":
            return w
        s = self.shapes.get(w)
        if s is None:
            if len(self.shapes) > 200_000:
                self.shapes.clear()
            s = self.shapes[w] = "~" + shape(w)
        return s

    def p(self, w: str, v: str, u: str | None) -> float:
        """P(w | u v), interpolated down to the unigram; after a word, given no boundary."""
        x = (self.uni.get(w, 0) + 0.1) / (self.total + 1000)
        c = self.bi.get(v)
        if c is not None:
            x = (c.get(w, 0.0) + c["#types"] * x) / (c["#sum"] + c["#types"])
        if u is not None:
            c = self.tri.get((u, v))
            if c is not None:
                x = (c.get(w, 0.0) + c["#types"] * x) / (c["#sum"] + c["#types"])
        return x

    def ends(self, v: str, u: str) -> float:
        """P(<b> | u v)."""
        x = self.end2.get(v)
        if x is None:
            if self.base is not None:
                return self.base
            # a mark never seen here ends sentences, as all but the full stop nearly always do
            unseen = 0.98 if v[0] != "<" and v[-1] in _STOP and v[-1] not in ".…" else 0.5
            x = self.end2.get("~" + shape(v) if v[0] != "~" else v, unseen)
        return self.end3.get((u, v), x)

    def learn_plain(self, seqs: list[tuple[list[str], list[int]]], beliefs: list[list[float]]) -> None:
        """The model for text without marks: punctuated blocks of scripts without spaces, their
        marks taken out, with what is believed of the boundaries between the words that remain."""
        plain: list[tuple[list[str], list[int]]] = []
        known: list[list[float]] = []
        n3: Counter = Counter()
        e3: Counter = Counter()
        for (w, _), belief in zip(seqs, beliefs):
            if not solid(w):
                continue
            words, after = unmarked(w, belief)
            if len(words) < 2:
                continue
            plain.append((words, [1] * len(words)))
            known.append(after)
            for k, q in zip(contexts(words, after), after):
                n3[k] += 1
                e3[k] += q
        if not plain:
            return
        m = EventModel(self.vocab)
        m.believe(n3, e3)
        m.learn(plain, known)
        self.plain = m

    def believe(self, n3: Counter, e3: Counter) -> None:
        """Boundary probabilities from sightings of ``(word before, word)`` and what is believed of them."""
        n2, e2 = _of_words(n3), _of_words(e3)
        self.base = sum(e2.values()) / sum(n2.values())
        self.end2 = {v: (e2[v] + 3 * self.base) / (n + 3) for v, n in n2.items()}
        self.end3 = {k: (e3[k] + 3 * self.end2[k[1]]) / (n + 3) for k, n in n3.items()}

    def posteriors(self, w: list[str], gaps: list[int], k: int, m: int) -> list[float]:
        """Forward-backward over the adjacent possible boundaries after words k..m."""
        before = w[k - 1] if k and gaps[k - 1] != 2 else B
        nxt2 = w[m + 2] if m + 2 < len(w) and gaps[m + 1] != 2 else B
        key = (before, *w[k : m + 2], nxt2)
        got = self.memo.get(key)
        if got is not None:
            return got
        p = self.p
        n = m - k + 1
        # state: whether a boundary precedes the current word; step i decides the gap after word k+i
        alpha = [(1.0, 0.0)]
        steps = []
        for i in range(n):
            word, follow = w[k + i], w[k + i + 1]
            step = []
            for s in (0, 1):
                u = B if s else (w[k + i - 1] if i else before)
                e = self.ends(word, u)
                # a word never seen before says nothing of what precedes it
                step.append(((1 - e) * p(follow, word, u), e * p(follow, B, word)) if follow in self.uni else (1 - e, e))
            steps.append(step)
            a0, a1 = alpha[-1]
            x0, x1 = a0 * step[0][0] + a1 * step[1][0], a0 * step[0][1] + a1 * step[1][1]
            z = x0 + x1 or 1.0
            alpha.append((x0 / z, x1 / z))
        last = w[m + 1]
        beta = [(p(nxt2, last, w[m]), p(nxt2, last, B)) if last in self.uni and nxt2 in self.uni else (1.0, 1.0)]
        for i in range(n - 1, -1, -1):
            b0, b1 = beta[-1]
            y = tuple(steps[i][s][0] * b0 + steps[i][s][1] * b1 for s in (0, 1))
            z = y[0] + y[1] or 1.0
            beta.append((y[0] / z, y[1] / z))
        beta.reverse()
        out = []
        for i in range(1, n + 1):
            x0, x1 = alpha[i][0] * beta[i][0], alpha[i][1] * beta[i][1]
            out.append(x1 / (x0 + x1) if x0 + x1 else 0.5)
        if len(self.memo) > 300_000:
            self.memo.clear()
        if n < 8:
            self.memo[key] = out
        return out

    def decide(self, w: list[str], gaps: list[int]) -> list[float]:
        """Posterior of a boundary after each word; the last word's is certain."""
        n = len(w)
        out = [1.0 if g == 2 else 0.0 for g in gaps]
        i = 0
        while i < n - 1:
            if gaps[i] != 1:
                i += 1
                continue
            m = i
            while m + 1 < n - 1 and gaps[m + 1] == 1:
                m += 1
            out[i : m + 1] = self.posteriors(w, gaps, i, m)
            i = m + 1
        out[-1] = 1.0
        return out

    def observe(self, n3: Counter, e3: Counter, share: float = 1.0, shrink: float = 20.0) -> None:
        """Boundary probabilities from ``(word before, word)`` where a boundary may be, and at block
        ends; each sighting weighs ``share``."""
        n3, e3 = (Counter({k: n * share for k, n in c.items()}) for c in (n3, e3))
        n2, e2 = _of_words(n3), _of_words(e3)
        rates = sorted((e2[v] / n, n) for v, n in n2.items() if n >= 20 and e2[v] / n > 0.05)
        half, seen, rho = sum(n for _, n in rates) / 2, 0, 0.25
        for r, n in rates:
            seen += n
            if seen >= half:
                rho = r
                break
        # the rate scatters around rho for words that always end a sentence: what is near counts as equal
        clip = lambda x: 0.998 if x > 0.7 else max(0.002, x)


        def prior(v: str) -> tuple[float, float]:
            """Expectation of a word never seen at a block end, and its weight in sightings."""
            if v[0] == "<" or v.endswith(("…", "..")):
                return 0.3, 2.0
            if v.rstrip("\"'”’»)]")[-1] != ".":
                return 0.98, 400.0
            stem = v.strip("~.")
            if v[0] != "~" and len(stem) > 3 and stem.isalpha() and stem.islower():
                return 0.7, 300.0
            return (0.7, 60.0) if len(stem) > 3 and "." not in stem or v[0] == "~" else (0.3, 2.0)

        self.end2 = {}
        for v, n in n2.items():
            x, a = prior(v)
            self.end2[v] = clip((e2[v] / rho + x * a) / (n + a))
        self.end3 = {}
        for k, n in n3.items():
            if n >= 8:
                a = max(shrink, prior(k[1])[1])
                self.end3[k] = clip((e3[k] / rho + a * self.end2[k[1]]) / (n + a))

    def learn(self, seqs: list[tuple[list[str], list[int]]], beliefs: list[list[float]]) -> None:
        uni: Counter = Counter()
        seen: Counter = Counter()
        for (w, gaps), belief in zip(seqs, beliefs):
            uni.update(w)
            uni[B] += 1
            for k in certain(w, gaps):
                seen[k] += 1
            for k, p in believed(w, gaps, belief):
                seen[k] += p
        self.fit(uni, seen)

    def fit(self, uni: Counter, seen: dict) -> None:
        """Take counts of words and of trigrams ``(u, v, x)``; without u those of a bigram alone."""
        bi: dict = defaultdict(lambda: defaultdict(float))
        tri: dict = defaultdict(lambda: defaultdict(float))
        for (u, v, x), p in seen.items():
            bi[v][x] += p
            if u is not None:
                tri[u, v][x] += p
        self.uni, self.total = uni, float(sum(uni.values()))
        for table in (bi, tri):
            for c in table.values():
                s, t = sum(c.values()), float(len(c))
                c["#sum"], c["#types"] = s, t
        self.bi, self.tri = {k: dict(c) for k, c in bi.items()}, {k: dict(c) for k, c in tri.items()}
        self.memo = {}


def _of_words(pairs: Counter) -> Counter:
    out: Counter = Counter()
    for (_, v), n in pairs.items():
        out[v] += n
    return out


def certain(w: list[str], gaps: list[int]) -> Iterator[tuple]:
    """N-grams that follow from layout and certain boundaries."""
    yield None, B, w[0]
    yield B, w[0], w[1] if len(w) > 1 else B
    for i in range(len(w) - 1):
        if gaps[i] == 2:
            yield None, B, w[i + 1]


def believed(w: list[str], gaps: list[int], belief: list[float]) -> Iterator[tuple[tuple, float]]:
    """N-grams around possible boundaries, each with its probability."""
    n = len(w)
    for i in range(n - 1):
        if gaps[i] != 1:
            continue
        q = belief[i]
        x = w[i + 2] if i + 2 < n else B
        if i and not q and not belief[i - 1]:  # none before and none here, as between most characters
            yield (w[i - 1], w[i], w[i + 1]), 1.0
            yield (w[i], w[i + 1], x), 1.0
            continue
        # the word before is a boundary itself with its own belief
        for u, pu in [(B, 1.0)] if not i else [(w[i - 1], 1 - belief[i - 1]), (B, belief[i - 1])]:
            if (1 - q) * pu > 1e-4:
                yield (u, w[i], w[i + 1]), (1 - q) * pu
        if 1 - q > 1e-4:
            yield (w[i], w[i + 1], x), 1 - q
        if q > 1e-4:
            yield (w[i], B, w[i + 1]), q
            yield (B, w[i + 1], x), q


def ends_seen(w: list[str], gaps: list[int]) -> Iterator[tuple[tuple[str, str], bool]]:
    """``(word before, word)`` of every possible boundary, and whether it is the block's end."""
    for i, g in enumerate(gaps):
        if g == 1:
            yield (w[i - 1] if i else B, w[i]), i == len(w) - 1


def solid(w: list[str]) -> bool:
    return sum(1 for x in w if _ONE_SOLID.match(x)) > 0.6 * len(w)


def unmarked(w: list[str], belief: list[float]) -> tuple[list[str], list[float]]:
    """A block without its marks, and what is believed of a boundary after each word that remains."""
    words: list[str] = []
    after: list[float] = []
    for x, q in zip(w, belief):
        if x[0] == "<" or any(c.isalnum() for c in x):
            words.append(x)
            after.append(q)
        elif words:
            after[-1] = max(after[-1], q)
    return words, after


def contexts(words: list[str], after: list[float]) -> Iterator[tuple[str, str]]:
    for i, w in enumerate(words):
        yield words[i - 1] if i and after[i - 1] < 0.5 else B, w


def first_belief(w: list[str], gaps: list[int]) -> list[float]:
    """Rough start for training, from punctuation and letter case alone."""
    out = []
    for i, (x, g) in enumerate(zip(w, gaps)):
        if i == len(w) - 1 or g == 2:
            out.append(1.0)
        elif not g:
            out.append(0.0)
        else:
            y = w[i + 1]
            if x[0] == "<":
                q = 0.7 if x[1] == "r" and (i == 0 or out[i - 1] > 0.5) else 0.05 if x[1] == "r" else 0.3
            elif x[-1] in "!?؟।॥" + _WIDE:
                q = 0.95
            elif x.endswith(("…", "...", "..")):
                q = 0.4
            else:
                stem = x.rstrip(".")
                q = 0.1 if "." in stem or len(stem) <= 2 else 0.8
            if y[:1].islower() and x[0] != "<" and y[0] not in "<~":
                q *= 0.3
            out.append(q)
    return out


def thinned(total: int) -> float:
    """What one sighting weighs against fixed expectations. Weights of these and least counts suit
    texts of up to ``SIGHTED`` words; more text repeats passages, so it makes rates surer, but an
    expectation of a word not proportionally weaker."""
    return min(1.0, SIGHTED / max(1, total))


def free_words(model: EventModel, raw: list[tuple[list[str], list[int]]], freq: Counter, common: float = COMMON, variety: float = VARIETY) -> set[str]:
    """Names that are merely frequent: unlike words of the language they stand in any place, so
    both what precedes and what follows them keeps changing."""
    before: dict = defaultdict(Counter)
    after: dict = defaultdict(Counter)
    total = sum(freq.values())
    share = thinned(total)
    for w, _ in raw:
        x = [B, *[model.norm(y) for y in w], B]
        for i in range(1, len(x) - 1):
            before[x[i]][x[i - 1]] += 1
            after[x[i]][x[i + 1]] += 1
    kinds = lambda c: sum(1 - (1 - share) ** n for n in c.values())  # noqa: E731  expected in that share of the text
    return {w for w in model.vocab if freq[w] < common * total and w[0] != "<" and min(kinds(before[w]), kinds(after[w])) > max(4, variety * freq[w] * share)}


def train(texts: list[str], rounds: int = ROUNDS, rare: float = RARE) -> EventModel:
    """Fit the model to the prose blocks of unlabelled texts.

    Words rarer than ``rare`` of all words are known by their shape only.
    """
    raw = [tokens(t, s, e) for t in texts for s, e, line in blocks(t) if not line]
    raw = [(w, g) for w, _, _, g in raw if w]
    freq = Counter(x for w, _ in raw for x in w)
    least = max(6, rare * sum(freq.values()))
    model = EventModel({x for x, c in freq.items() if c >= least})
    model.vocab -= free_words(model, raw, freq)
    seqs = [([model.norm(x) for x in w], g) for w, g in raw]
    n3: Counter = Counter()
    e3: Counter = Counter()
    for w, g in seqs:
        for k, end in ends_seen(w, g):
            n3[k] += 1
            e3[k] += end
    model.observe(n3, e3, thinned(sum(freq.values())))
    beliefs = [first_belief(w, g) for w, g in seqs]
    for _ in range(rounds):
        model.learn(seqs, beliefs)
        beliefs = [model.decide(w, g) for w, g in seqs]
    model.learn_plain(seqs, beliefs)
    return model


_LOGISH = "log"


def units(text: str, kind: str | None, model: EventModel) -> Iterator[tuple[int, int]]:
    """Sentence units of one document as code point ranges, in order."""
    if kind == _LOGISH:
        at, n = 0, len(text)
        while at < n:
            e = text.find("\n", at)
            e = n if e < 0 else e
            line = text[at:e]
            body = line.strip()
            if body:
                s = at + len(line) - len(line.lstrip())
                yield s, s + len(body)
            at = e + 1
        return
    norm = model.norm
    for start, end, is_line in blocks(text):
        if is_line:
            line = text[start:end]
            s = start + len(line) - len(line.lstrip())
            yield s, s + len(line.strip())
            continue
        w, begins, ends, gaps = tokens(text, start, end)
        if not w:
            continue
        if 1 in gaps[:-1]:
            post = model.decide([norm(x) for x in w], gaps)
        elif model.plain and (open_ := plain_gaps(w, gaps)):
            post = model.plain.decide([norm(x) for x in w], open_)
        else:
            post = gaps  # certain boundaries only
        s = begins[0]
        last = len(w) - 1
        for i, q in enumerate(post):
            if i == last:
                yield s, ends[i]
            elif q > 0.5:
                yield s, ends[i]
                s = begins[i + 1]


def training_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = "doc_kind", n: int = SAMPLE_DOCS, span: int = 20_000) -> list[str]:
    """Texts for a model of its own, which :func:`sentence_units` does not use unless it is given one:
    at most ``n`` prose texts by hash of their id; of a text of more than ``span`` characters a
    span of that length whose place is drawn by hash too, from line end to line end.

    The hash range is narrowed to about twice the sample first, so every partition sends its
    share only, however many there are.
    """
    share = min(1_000_000, -(-2_000_000 * n // max(1, docs.count())))
    docs = docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(11)), F.lit(1_000_000)) < share)
    prose = docs.where(F.col(text).isNotNull())
    if kind:
        prose = prose.where(F.coalesce(F.col(kind), F.lit("")) != _LOGISH)
    t, size = F.col(text), F.length(text)
    start = F.pmod(F.xxhash64(F.col(doc_id), F.lit(5)), F.greatest(F.lit(1), size - span + 1)).cast("int") + 1
    part = F.regexp_replace(F.regexp_replace(F.substring(t, start, F.lit(span)), r"\A[^\n]*\n", ""), r"\n[^\n]*\z", "")
    ids = prose.select(F.xxhash64(F.col(doc_id)).alias("o"), F.when(size <= span, t).otherwise(part).alias("t")).orderBy("o").limit(n)
    return [r.t for r in ids.collect()]


_TOKENS = "words array<string>, n array<long>, part binary, code binary, gap binary, size binary, begin binary, ids array<long>, doc binary, line binary"
_CLOSES, _SPACED_AFTER, _FREE, _DOTS, _BOUND, _ENDS_THAI, _STARTS_THAI, _FOLLOWS = (1 << i for i in range(8))  # what a part tells
_parts: dict[str | tuple, tuple[str, int, int, int]] = {}


class _Numbers(dict):
    """Numbers of keys in order of their first use."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def _part(x: str | tuple) -> tuple[str, int, int, int]:
    """Word of a part, its length without and with the white space behind, and what :func:`_gaps` asks of it."""
    got = _parts.get(x)
    if got is None:
        if len(_parts) > 200_000:
            _parts.clear()
        if isinstance(x, str):
            raw = x.rstrip()
            n, full, first, last = len(raw), len(x), raw[0], raw[-1]
            if raw.isascii() and raw.isalnum():
                got = _parts[x] = raw if raw.isalpha() else _DIGITS.sub("0", raw), n, full, _SPACED_AFTER * (full > n)
                return got
            w, tells = _word(raw)
            closing = tells >= _CLOSING
        else:
            w, n, full, last = x
            closing, first = "." in w, "("
        told = _CLOSES * closing + _SPACED_AFTER * (full > n) + _FREE * (w[-1] in _WIDE or w[0] == "<") + _DOTS * (w[-1] == "…")
        told += _BOUND * (w[0] == "<" and last not in "」』）”】") + _ENDS_THAI * ("ก" <= last <= "๎") + _STARTS_THAI * ("ก" <= first <= "๎") + _FOLLOWS * bool(_GOES_ON.match(first))
        got = _parts[x] = w, n, full, told
    return got


def _block_parts(text: str, start: int, end: int) -> list[str | tuple]:
    """The words of a block with the white space behind each; of quoted and bracketed stretches the
    word they are to the model, its lengths and last character."""
    find = _PART.findall
    if not _OPENER.search(text, start, end):
        return find(text, start, end)
    out: list[str | tuple] = []
    at = start
    for i, j in spans(text, start, end).items():
        out += find(text, at, i)
        body = text[i + 1 : j - 1].rstrip()
        w = ("<r" if text[i] in _BRACKETS else "<q") + ("." if body[-1:] in _STOP and body else "") + (":" if i > start and text[i - 1].isspace() else "") + ">"
        space = _SPACE.match(text, j, end)
        at = space.end() if space else j
        out.append((w, j - i, at - i, text[j - 1]))
    return out + find(text, at, end)


def _gaps(told: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The kinds of gap that :func:`tokens` gives, from what each part tells; ``last`` tells where a block ends."""
    follow = np.roll(told, -1)
    follow[last] = 0
    is_ = lambda x, bit: (x & bit) != 0
    spaced = is_(told, _SPACED_AFTER) | last
    closed = is_(told, _CLOSES) & (spaced | is_(told, _FREE) | is_(told, _DOTS) & is_(follow, _FOLLOWS))
    thai = ~closed & spaced & is_(told, _ENDS_THAI) & is_(follow, _STARTS_THAI)
    return (closed & (spaced | ~is_(told, _BOUND))).astype(np.int8) + 2 * thai.astype(np.int8)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts ``(id, text, kind)`` to the words of their blocks, numbered within rows of whole texts
    and about ``ROW_TOKENS`` words: distinct words and their counts; of distinct parts the word's
    number and lengths; numbers of parts, kinds of gap, sizes and first places of blocks; ids of
    texts, each block's text; and text, start and end of lines that are units by themselves."""
    index = _Numbers()
    code, size, begin, doc, line, ids = array("i"), array("i"), array("i"), array("i"), array("i"), []

    def row() -> pa.RecordBatch:
        number, get = _Numbers(), _parts.get
        words, *rest = zip(*[get(x) or _part(x) for x in index]) if index else [()] * 4
        part = np.array([[number[w] for w in words], *rest], np.int32).T
        x = np.frombuffer(code, np.int32)
        last = np.zeros(len(x), bool)
        last[np.cumsum(np.frombuffer(size, np.int32)) - 1] = True
        gap = _gaps(part[:, 3][x], last)
        n = np.bincount(part[:, 0], np.bincount(x, minlength=len(part)), len(number)).astype(np.int64)
        columns = [pa.array([list(number)], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))]
        columns += [pa.array([y.tobytes()], pa.binary()) for y in (part[:, :3], code, gap, size, begin)]
        columns += [pa.array([ids], pa.list_(pa.int64())), pa.array([doc.tobytes()], pa.binary()), pa.array([line.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["words", "n", "part", "code", "gap", "size", "begin", "ids", "doc", "line"])

    for b in batches:
        for key, text, kind in zip(*(c.to_pylist() for c in b.columns)):
            if not text:
                continue
            d = len(ids)
            ids.append(key)
            if kind == _LOGISH:
                for m in _LINE.finditer(text):
                    line.extend((d, *m.span()))
            else:
                for start, end, is_line in blocks(text):
                    if is_line:
                        line.extend((d, *_LINE.search(text, start, end).span()))
                    elif parts := _block_parts(text, start, end):
                        while text[start].isspace():
                            start += 1
                        code.extend(map(index.__getitem__, parts))
                        size.append(len(parts))
                        begin.append(start)
                        doc.append(d)
            if len(code) + len(line) >= ROW_TOKENS:
                yield row()
                index = _Numbers()
                code, size, begin, doc, line, ids = array("i"), array("i"), array("i"), array("i"), array("i"), []
    if ids:
        yield row()


def _numbers(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for words, n, part, code, gap, size in zip(*b.columns):
            if len(words):
                yield words.as_py(), n.values.to_numpy(), _numbers(part)[::3][_numbers(code)], np.frombuffer(gap.as_buffer(), np.int8), _numbers(size)


def _distinct(rows: np.ndarray, top: int, places: bool = False) -> tuple[list, list | np.ndarray]:
    """Distinct rows of numbers below ``top``, and their counts, or for each row which of them it is."""
    width = rows.shape[1]
    told = {"return_inverse": True} if places else {"return_counts": True}
    if top**width < 1 << 62:  # one number a row is sorted much faster
        unit = top ** np.arange(width - 1, -1, -1)
        key, more = np.unique(rows @ unit, **told)
        rows = key[:, None] // unit % top
    else:
        rows, more = np.unique(rows, axis=0, **told)
    return rows.tolist(), more.reshape(-1) if places else more.tolist()


class _Counts:
    """Sums by kind and key, handed on when they are many. Words hold no space, so keys are joined by it."""

    schema = "kind string, key string, n long"

    def __init__(self):
        self.n: dict = defaultdict(lambda: defaultdict(int))

    def add(self, kind: str, key: tuple, n: int) -> None:
        self.n[kind][key] += n

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if sum(map(len, self.n.values())) >= least:
            for kind, sums in self.n.items():
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(sums), pa.string()), pa.array(list(map(" ".join, sums)), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["kind", "key", "n"])
            self.n.clear()


def _key(u: str | None, v: str, x: str) -> tuple[str, str, str]:
    return u or "", v, x


def _neighbours(vocab: set[str], wanted: set[str]):
    """How often which words stand before and after each wanted word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = EventModel(vocab).norm
        out = _Counts()
        for words, _, code, _, size in _rows(batches):
            ids: dict[str, int] = {B: 0}
            x = np.array([ids.setdefault(norm(w), len(ids)) for w in words])[code]
            names = list(ids)
            mine = np.array([w in wanted for w in names])[x]
            last = np.cumsum(size) - 1
            before, after = np.roll(x, 1), np.roll(x, -1)
            before[last - size + 1] = 0
            after[last] = 0
            for kind, y in (("before", before), ("after", after)):
                for k, n in zip(*(c.tolist() for c in np.unique(x[mine] * len(names) + y[mine], return_counts=True))):
                    out.add(kind, (names[k // len(names)], names[k % len(names)]), n)
            yield from out.batches(HELD)
        yield from out.batches()

    return run


def _stretches(gap: np.ndarray, last: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Places of the stretches of blocks that hold adjacent possible boundaries, by their kinds of
    gap: all that their posteriors depend on, words from the one before to the second after.
    ``last`` tells where a block ends."""
    first = np.append(True, last[:-1])
    open_ = (gap == 1) & ~last
    k = np.flatnonzero(open_ & (first | ~np.append(False, open_[:-1])))
    m = np.flatnonzero(open_ & ~np.append(open_[1:], False))  # a block's last gap is never open
    length = m - k + 1
    led = ~first[k] & (gap[k - 1] != 2)
    more = ~last[m + 1]
    sort = length * 8 + led * 4 + (gap[m + 1] == 2) * 2 + more
    for kind in np.unique(sort).tolist():
        at = k[sort == kind]
        n, led_, two, more_ = kind // 8, kind // 4 % 2, kind // 2 % 2, kind % 2
        yield "0" * led_ + "1" * n + ("2" if two else "0") + "0" * more_, at[:, None] + np.arange(-led_, n + 1 + more_)


def _counted(vocab: set[str]):
    """What training takes from the text: words, certain n-grams, possible boundaries and those at
    block ends, stretches with possible boundaries, and whole blocks of scripts without spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = EventModel(vocab).norm
        out = _Counts()
        for words, n, code, gap, size in _rows(batches):
            ids: dict[str, int] = {B: 0}
            to = np.array([ids.setdefault(norm(w), len(ids)) for w in words])
            names = list(ids)
            x = to[code]
            end = np.cumsum(size)
            begin = end - size
            last = np.zeros(len(x), bool)
            last[end - 1] = True
            before, after = np.roll(x, 1), np.roll(x, -1)
            before[begin] = after[last] = 0

            def add(kind: str, *columns: np.ndarray, lead: tuple = ()) -> None:
                for r, c in zip(*_distinct(np.stack(columns, axis=1), len(names))):
                    out.add(kind, (*lead, *[names[y] for y in r]), c)

            for w, c in zip(to.tolist(), n.tolist()):
                out.add("word", (names[w],), c)
            out.add("word", (B,), len(size))
            sure = np.flatnonzero((gap == 2) & ~last)
            add("certain", np.append(x[begin], x[sure + 1]), lead=("", B))
            add("certain", x[begin], after[begin], lead=(B,))
            maybe = gap == 1
            add("possible", before[maybe], x[maybe])
            add("end", before[maybe & last], x[maybe & last])
            for kinds, places in _stretches(gap, last):
                add("stretch", *x[places].T, lead=(kinds,))
            plain = np.array([not w.isascii() and bool(_ONE_SOLID.match(w)) for w in names])[x].astype(np.int64)
            for i in np.flatnonzero(np.add.reduceat(plain, begin) > 0.6 * size).tolist():
                part = slice(begin[i], end[i])
                out.add("solid", ("".join(map(str, gap[part].tolist())), *[names[y] for y in x[part].tolist()]), 1)
            yield from out.batches(HELD)
        yield from out.batches()

    return run


def _boundaries(words: list[str], code: np.ndarray, gap: np.ndarray, size: np.ndarray, model: EventModel) -> np.ndarray:
    """Whether a unit ends after each word, as :func:`units` decides; equal stretches are weighed once."""
    ids = _Numbers()
    x = np.array([ids[model.norm(w)] for w in words])[code]
    names = list(ids)
    end = np.cumsum(size)
    last = np.zeros(len(code), bool)
    last[end - 1] = True
    out = last | (gap == 2)
    for kinds, places in _stretches(gap, last):
        gaps = list(map(int, kinds))
        k = kinds.index("1")
        m = kinds.rindex("1")
        rows, which = _distinct(x[places], len(names), places=True)
        post = np.array([model.posteriors([names[y] for y in r], gaps, k, m) for r in rows])
        out[places[:, k : m + 1]] = post[which] > 0.5
    if model.plain:
        sorts = np.array([(0, 0) if w.isascii() else (bool(_ONE_SOLID.match(w)), bool(_LETTERED.match(w))) for w in words], np.int64)[code]
        begin = end - size
        open_ = (np.add.reduceat(sorts, begin) > 0.6 * size[:, None]).any(axis=1) & (size > 1) & (np.maximum.reduceat(gap, begin) == 0)
        for i in np.flatnonzero(open_).tolist():
            part = slice(begin[i], end[i])
            out[part] = np.array(model.plain.decide([names[y] for y in x[part].tolist()], [1] * int(size[i]))) > 0.5
    return out


def _cut(model: EventModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentence units of tokenised texts."""
    for b in batches:
        for words, _, part, number, gap, size, begin, ids, doc, line in zip(*b.columns):
            docs, starts, ends = _numbers(line).reshape(-1, 3).T
            if len(words):
                size = _numbers(size)
                word, long, full = _numbers(part).reshape(-1, 3)[_numbers(number)].T
                at = np.cumsum(full) - full
                at += np.repeat(_numbers(begin) - at[np.cumsum(size) - size], size)
                stop = _boundaries(words.as_py(), word, np.frombuffer(gap.as_buffer(), np.int8), size, model)
                start = np.append(True, stop[:-1])
                docs = np.append(docs, np.repeat(_numbers(doc), size)[stop])
                starts, ends = np.append(starts, at[start]), np.append(ends, (at + long)[stop])
            order = np.lexsort((starts, docs))
            docs = docs[order]
            of = np.bincount(docs, minlength=len(ids))
            no = np.arange(1, len(docs) + 1) - np.repeat(np.cumsum(of) - of, of)
            columns = [ids.values.take(pa.array(docs)), pa.array(no, pa.int32()), pa.array(starts[order], pa.int32()), pa.array(ends[order], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)


def _weighed(model: Callable[[], EventModel | None], plain: bool = False):
    """N-grams of stretches as the model believes of their boundaries, or without a model as
    :func:`first_belief` does; or of whole blocks what the model for text without marks learns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        out = _Counts()
        for b in batches:
            for key, n in zip(*(c.to_pylist() for c in b.columns)):
                kinds, *w = key.split(" ")
                gaps = list(map(int, kinds))
                belief = m.decide(w, gaps) if m else first_belief(w, gaps)
                if plain:
                    w, belief = unmarked(w, belief)
                    if len(w) < 2:
                        continue
                    gaps = [1] * len(w)
                    word, possible, ends = out.n["word"], out.n["possible"], out.n["end"]
                    for x in (*w, B):
                        word[(x,)] += n * ONE
                    for x in certain(w, gaps):
                        out.add("ngram", _key(*x), n * ONE)
                    for x, q in zip(contexts(w, belief), belief):
                        possible[x] += n * ONE
                        ends[x] += n * round(q * ONE) if q else 0
                ngrams = out.n["ngram"]
                for x, p in believed(w, gaps, belief):
                    ngrams[x] += n * round(p * ONE)
                yield from out.batches(HELD)
        yield from out.batches()

    return run


def _sums(counts: DataFrame, unit: int = 1) -> dict[str, Counter]:
    """Kind to key to sum."""
    t = counts.groupBy("kind", "key").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toArrow()
    out: dict[str, Counter] = defaultdict(Counter)
    for kind, key, n in zip(*(c.to_pylist() for c in t.columns)):
        x = key.split(" ")
        out[kind][x[0] if kind == "word" else (x[0] or None, *x[1:])] = n / unit
    return out


def train_on(saved: DataFrame, scratch: Scratch, rounds: int = ROUNDS, rare: float = RARE) -> EventModel:
    """The model that :func:`train` fits, from every prose text of a table of tokenised texts, each text whole.

    What the rounds need of the texts is counted where they lie: equal stretches around possible boundaries have equal posteriors, so each round weighs
    distinct stretches only. The driver gets the vocabulary, at most 1/``rare`` words, and the
    n-grams next to possible boundaries, which are the model; no text.
    """
    spark = saved.sparkSession
    rows = saved.select("words", "n", "part", "code", "gap", "size")
    each = saved.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select(F.col("x.words").alias("w"), F.col("x.n").alias("n"))
    counts, seen = scratch.save_with(each.groupBy("w").agg(F.sum("n").alias("n")), total=F.sum("n"))
    total = seen["total"] or 0
    freq = {r.w: r.n for r in counts.where(F.col("n") >= max(6, rare * total)).collect()}
    scratch.drop(counts)
    vocab = set(freq)
    wanted = {w for w, n in freq.items() if n < COMMON * total and w[0] != "<"}
    share = thinned(total)
    near = rows.mapInArrow(_neighbours(vocab, wanted), _Counts.schema).groupBy("kind", "key").agg((1 - F.pow(F.lit(1 - share), F.sum("n"))).alias("seen"))
    variety = near.groupBy(F.split("key", " ")[0].alias("w")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("seen"))).alias(k) for k in ("before", "after")])
    vocab = vocab - {r.w for r in variety.collect() if min(r.before, r.after) > max(4, VARIETY * freq[r.w] * share)}

    counted = scratch.save(rows.mapInArrow(_counted(vocab), _Counts.schema).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    got = _sums(counted.where("kind NOT IN ('stretch', 'solid')"))
    of = lambda k: counted.where(F.col("kind") == k).select("key", "n")
    model = EventModel(vocab)
    model.observe(got["possible"], got["end"], share)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(model.state() if i else None)
        believe = lambda s=shared: s.value and EventModel.of(s.value)
        model.fit(got["word"], got["certain"] + _sums(of("stretch").mapInArrow(_weighed(believe), _Counts.schema), ONE)["ngram"])
        shared.destroy()
    shared = spark.sparkContext.broadcast(model.state())
    x = _sums(of("solid").mapInArrow(_weighed(lambda: EventModel.of(shared.value), True), _Counts.schema), ONE)
    shared.destroy()
    scratch.drop(counted)
    if x["word"]:
        model.plain = EventModel(vocab)
        model.plain.believe(x["possible"], x["end"])
        model.plain.fit(x["word"], x["ngram"])
    return model


def save_model(spark, model: EventModel, path: str) -> None:
    """Keep a model on shared storage, for later runs and streams."""
    pairs = lambda d: [[*k, v] for k, v in d.items()]

    def flat(x: tuple | None):
        return x and [sorted(x[0]), x[1], x[2], x[3], pairs(x[4]), x[5], pairs(x[6]), x[7], flat(x[8])]

    spark.createDataFrame([(json.dumps(flat(model.state())),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> EventModel:
    keyed = lambda rows: {(a, b): v for a, b, v in rows}

    def back(x: list | None):
        return x and (set(x[0]), x[1], x[2], x[3], keyed(x[4]), x[5], keyed(x[6]), x[7], back(x[8]))

    return EventModel.of(back(json.loads(spark.read.parquet(path).first().model)))


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = "doc_kind", model: EventModel | None = None) -> DataFrame:
    """``(doc_id, sent_no, start_char, end_char)``: one row per sentence unit of every document.

    Offsets count code points from 0, end exclusive, without surrounding white space. The model
    is fitted to all prose of the table unless one is given. Null, empty and blank texts
    have no units; a null kind means prose; texts of any length are cut whole; repeated rows come
    out as often as they occur; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.col(kind) if kind else F.lit(None)).cast("string").alias("kind"))
    rows = spread(rows).mapInArrow(_tokenised, _TOKENS)
    if model is None:
        scratch = Scratch(spark)
        rows = scratch.save(rows)
        model = train_on(rows, scratch)
    shared = spark.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(EventModel.of(shared.value), batches)

    return rows.mapInArrow(run, SCHEMA)
