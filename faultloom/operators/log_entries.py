"""Semi-structured log lines into entries with time, level, component and message.

Every known layout owns literal anchors: strings that its header lines must hold at their start.
One Aho-Corasick pass over a text finds all anchors at once and retrieves, for each line, the few
candidate layouts; an anchored expression then verifies the line and extracts its fields. A line
that no layout claims joins the entry before it. Cost is one automaton pass plus about one
expression for each header line, however many layouts are registered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.functions.text import ANSI
from faultloom.session import spread

LEVELS = {
    "trace": "TRACE", "verbose": "TRACE", "debug": "DEBUG", "info": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "crit": "FATAL", "critical": "FATAL", "fatal": "FATAL",
    "v": "TRACE", "t": "TRACE", "d": "DEBUG", "i": "INFO", "n": "INFO", "w": "WARN", "e": "ERROR", "c": "FATAL", "f": "FATAL",
    "information": "INFO", "informational": "INFO", "emerg": "FATAL", "alert": "FATAL", "panic": "FATAL",
}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MONTH = {m: i + 1 for i, m in enumerate(MONTHS)}
_WORD = r"[A-Za-z]+"
_ISO = r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?"
_ZONE = r"(Z|[+-]\d\d:?\d\d)?"
_END = r"[^\n]*"

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("entry_no", T.IntegerType()), T.StructField("ts_ms", T.LongType()), T.StructField("level", T.StringType()), T.StructField("component", T.StringType()), T.StructField("message", T.StringType()), T.StructField("n_lines", T.IntegerType())]
)


def epoch_day(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a proleptic Gregorian date; ValueError for impossible ones."""
    return datetime(y, m, d).toordinal() - 719163


_days: dict[tuple[int, int, int], int] = {}


def _day(y: int, m: int, d: int) -> int:
    k = (y, m, d)
    if (v := _days.get(k)) is None:
        v = _days[k] = epoch_day(y, m, d)
    return v


def _clock(h: str, mi: str, s: str, frac: str | None) -> int:
    hh, mm, ss = int(h), int(mi), int(s)
    if hh > 23 or mm > 59 or ss > 60:
        raise ValueError("no clock time")
    return ((hh * 60 + mm) * 60 + ss) * 1000 + (int(frac[:3].ljust(3, "0")) if frac else 0)


def _offset(zone: str | None) -> int:
    if not zone or zone == "Z":
        return 0
    minutes = int(zone[1:3]) * 60 + int(zone[-2:])
    return minutes * 60_000 if zone[0] == "+" else -minutes * 60_000


def _iso(g: tuple, zone: str | None = None) -> int:
    return _day(int(g[0]), int(g[1]), int(g[2])) * 86_400_000 + _clock(*g[3:7]) - _offset(zone)


def _without_year(month: int, day: int, ms: int, until: int | None) -> int | None:
    """The latest such instant not after ``until`` (epoch ms); none without that bound."""
    if until is None:
        _day(2000, month, day)
        return None
    year = datetime.fromtimestamp(until / 1000, timezone.utc).year
    for y in range(year, year - 9, -1):
        try:
            t = _day(y, month, day) * 86_400_000 + ms
        except ValueError:
            continue  # 29 February
        if t <= until:
            return t
    raise ValueError("no such day")


def _without_date(ms: int, until: int | None) -> int | None:
    if until is None:
        return None
    t = until - until % 86_400_000 + ms
    return t if t <= until else t - 86_400_000


_ESC = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ESC_OF = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def unquote(s: str) -> str:
    if "\\" not in s:
        return s
    return _ESC.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESC_OF.get(m[1], m[1]), s)


_LINE_NO = re.compile(r"(?:\[\d+\])?(?::\d+)?$")


def component_name(s: str) -> str:
    s = _LINE_NO.sub("", s.strip())
    return s[:-3] if s.endswith(".cc") else s


def level_name(s: str | None) -> str | None:
    return LEVELS.get(s.lower()) if s else None


Fields = tuple[int | None, str, str, str]


@dataclass(frozen=True)
class Layout:
    """``anchors`` stand at a line's start; ``read(match, until)`` gives (ts_ms, level,
    component, message), or raises ValueError where the line only looks alike."""

    name: str
    anchors: tuple[str, ...]
    pattern: re.Pattern
    read: Callable[[re.Match, int | None], Fields]


def _need(level: str | None) -> str:
    if (v := level_name(level)) is None:
        raise ValueError("no level")
    return v


def _read_json(m: re.Match, until: int | None) -> Fields:
    o = json.loads(m[0].rstrip())
    if not isinstance(o, dict):
        raise ValueError("no record")
    pick = lambda *keys: next((o[k] for k in keys if o.get(k) is not None), None)
    when, text = pick("time", "timestamp", "ts", "@timestamp"), pick("msg", "message")
    if when is None or text is None:
        raise ValueError("no record")
    lvl = pick("level", "severity", "lvl")
    return _any_time(when), level_name(str(lvl)) or "" if lvl is not None else "", component_name(str(pick("component", "logger", "name") or "")), str(text)


_TIME = re.compile(_ISO + r"\s?" + _ZONE + "$")


def _any_time(v: object) -> int:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return int(v) if abs(v) >= 1e11 else int(v * 1000)
    if m := _TIME.match(str(v).strip()):
        return _iso(m.groups()[:7], m[8])
    if re.fullmatch(r"\d{10,13}", str(v)):
        return int(str(v).ljust(13, "0"))
    raise ValueError("no time")


_PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=(?:"((?:[^"\\\n]|\\.)*)"|([^\s"]*))(?:[ \t]+|$)')


def _read_logfmt(m: re.Match, until: int | None) -> Fields:
    o: dict[str, str] = {}
    line, at = m[0].rstrip(), 0
    while at < len(line):
        p = _PAIR.match(line, at)
        if not p:
            break  # trailing words belong to no field
        o.setdefault(p[1], p[3] if p[2] is None else unquote(p[2]))
        at = p.end()
    when = o.get("time") or o.get("ts") or o.get("timestamp")
    text = o.get("msg", o.get("message"))
    if not when or text is None:
        raise ValueError("no record")
    return _any_time(when), level_name(o.get("level") or o.get("lvl") or o.get("severity")) or "", component_name(o.get("component") or o.get("logger") or ""), text


def _year_anchors() -> tuple[str, ...]:
    return ("19", "20", "21")


def _layouts() -> tuple[Layout, ...]:
    c = lambda p: re.compile(p)
    years = _year_anchors()
    return (
        Layout("record", ('{"', '{ "'), c(r"\{[^\n]*\}[ \t\r]*(?=\n|\Z)"), _read_json),
        Layout("pairs", ("ts=", "time=", "timestamp=", "lvl=", "level=", "severity="), c(r"[a-z]+=[^\n]*"), _read_logfmt),
        Layout("iso_level_bracket", years, c(rf"{_ISO}{_ZONE}[ \t]+({_WORD})[ \t]+\[([^\]\n]+)\]({_END})"), lambda m, u: (_iso(m.groups()[:7], m[8]), _need(m[9]), component_name(m[10]), m[11])),
        Layout("iso_component_level", years, c(rf"{_ISO}{_ZONE}[ \t]+([^\s:]+)[ \t]+({_WORD})(?:[ \t]+|(?=\n|\Z))({_END})"), lambda m, u: (_iso(m.groups()[:7], m[8]), _need(m[10]), component_name(m[9]), m[11])),
        Layout("dashes", years, c(rf"{_ISO}{_ZONE} - (\S+) - ({_WORD}) -({_END})"), lambda m, u: (_iso(m.groups()[:7], m[8]), _need(m[10]), component_name(m[9]), m[11])),
        Layout("iso_level_colon", years, c(rf"{_ISO}{_ZONE}[ \t]+({_WORD}):({_END})"), lambda m, u: (_iso(m.groups()[:7], m[8]), _need(m[9]), "", m[10])),
        Layout("pipes", tuple("123456789"), c(rf"(\d{{13}})\|({_WORD})\|([^|\n]*)\|({_END})"), lambda m, u: (int(m[1]), _need(m[2]), component_name(m[3]), m[4])),
        Layout("bracket_stamp", ("[19", "[20", "[21"), c(rf"\[{_ISO}{_ZONE}\][ \t]+\[({_WORD})\][ \t]+(\S+?):(?=\s|\Z)({_END})"), lambda m, u: (_iso(m.groups()[:7], m[8]), _need(m[9]), component_name(m[10]), m[11])),
        Layout("bracket_clock", ("[0", "[1", "[2"), c(rf"\[(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\][ \t]+(\S+?):[ \t]+({_WORD}):(?=\s|\Z)({_END})"), lambda m, u: (_without_date(_clock(*m.groups()[:4]), u), _need(m[6]), component_name(m[5]), m[7])),
        Layout("threads", tuple(f"{i:02d}-" for i in range(1, 13)), c(rf"(\d\d)-(\d\d)[ \t]+(\d\d):(\d\d):(\d\d)\.(\d+)[ \t]+\d+[ \t]+\d+[ \t]+([A-Z])[ \t]+([^\s:]+)[ \t]*:(?=\s|\Z)({_END})"), lambda m, u: (_without_year(int(m[1]), int(m[2]), _clock(*m.groups()[2:6]), u), _need(m[7]), component_name(m[8]), m[9])),
        Layout("letter_stamp", tuple(a + b for a in "TVDIWEF" for b in "01"), c(rf"([A-Z])(\d\d)(\d\d)[ \t]+(\d\d):(\d\d):(\d\d)\.(\d+)[ \t]+\d+[ \t]+([^\s\]]+?):\d+\]({_END})"), lambda m, u: (_without_year(int(m[2]), int(m[3]), _clock(*m.groups()[3:7]), u), _need(m[1]), component_name(m[8]), m[9])),
        Layout("host_program", tuple(f"{a} " for a in MONTHS), c(rf"([A-Z][a-z]{{2}})[ \t]+(\d{{1,2}})[ \t]+(\d\d):(\d\d):(\d\d)(?:\.(\d+))?[ \t]+\S+[ \t]+([^\s\[:]+)(?:\[\d+\])?:(?:[ \t]+<({_WORD})>)?(?=\s|\Z)({_END})"), lambda m, u: (_without_year(_MONTH[m[1]], int(m[2]), _clock(*m.groups()[2:6]), u), level_name(m[8]) or "", component_name(m[7]), m[9])),
        Layout("day_brackets", tuple(f"[{d} " for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")), c(rf"\[[A-Z][a-z]{{2}} ([A-Z][a-z]{{2}}) +(\d{{1,2}}) (\d\d):(\d\d):(\d\d)(?:\.(\d+))? (\d{{4}})\][ \t]+\[([^\]:\n]*):({_WORD})\](?:[ \t]+\[pid \d+(?::tid \d+)?\])?({_END})"), lambda m, u: (_day(int(m[7]), _MONTH[m[1]], int(m[2])) * 86_400_000 + _clock(*m.groups()[2:6]), _need(m[9]), component_name(m[8]), m[10])),
    )


LAYOUTS = _layouts()
_ANSI = re.compile(ANSI)


class EntryParser:
    """Parses whole texts; ``layouts`` may be extended by further ones."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.auto = ahocorasick.Automaton()
        owners: dict[str, list[Layout]] = {}
        for lay in layouts:
            for a in lay.anchors:
                owners.setdefault("\n" + a, []).append(lay)
        # an anchor that extends another one also stands for that one's layouts
        for a in owners:
            mine = [x for b, own in owners.items() if a.startswith(b) for x in own]
            self.auto.add_word(a, (len(a) - 1, tuple((x.pattern.match, x.read) for x in layouts if x in mine)))
        self.auto.make_automaton()

    def parse(self, text: str, until_ms: int | None) -> list[tuple[int, Fields]]:
        """``[(offset of the line in the escaped-free text, fields)]`` in text order."""
        found: dict[int, tuple] = {}
        for end, (back, layouts) in self.auto.iter("\n" + text):
            # the artificial leading newline shifts offsets by one
            found[end - back] = layouts  # a longer anchor at the same line comes later and wins
        out = []
        for at in sorted(found):
            for match, read in found[at]:
                if m := match(text, at):
                    try:
                        out.append((at, read(m, until_ms)))
                        break
                    except (ValueError, KeyError, OverflowError):
                        continue
        return out

    def entries(self, raw: str, until_ms: int | None) -> list[tuple[int, int | None, str, str, str, int]]:
        """Rows ``(entry_no, ts_ms, level, component, message, n_lines)`` of one text."""
        text = raw.replace("\r\n", "\n")
        if "\x1b" in text:
            text = _ANSI.sub("", text)
        heads = self.parse(text, until_ms)
        stop = len(text) - 1 if text.endswith("\n") else len(text)
        rows = []
        for i, (at, (ts, level, component, message)) in enumerate(heads):
            end = heads[i + 1][0] - 1 if i + 1 < len(heads) else stop
            rows.append((i + 1, ts, level, component, message.strip(), text.count("\n", at, end) + 1))
        return rows


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = EntryParser()
    for b in batches:
        cols: list[list] = [[] for _ in range(7)]
        add = [c.append for c in cols]
        for rid, until, text in zip(*(c.to_pylist() for c in b.columns)):
            if not text:
                continue
            for row in parser.entries(text, None if until is None else until // 1000):
                add[0](rid)
                for k in range(6):
                    add[k + 1](row[k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.string()) for c in cols[3:6]), pa.array(cols[6], pa.int32())], names=SCHEMA.names
        )


def log_entries(df: DataFrame, text: str = "excerpt", row_id: str = "id", seen_at: str = "analyzed_at") -> DataFrame:
    """``(id, entry_no, ts_ms, level, component, message, n_lines)``: one row per log entry.

    Lines before the first header belong to no entry. Null, empty or headerless texts give no
    rows; with a null ``seen_at`` entries come out all the same, and ``ts_ms`` is null only for
    those that print no year or no date; a null id stays null; repeated rows each give their own
    entries; an empty table gives no rows; texts of any length are parsed whole; other columns
    are never read, whatever their names.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.unix_micros(F.col(seen_at).cast("timestamp")).alias("until"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(_parse_batches, SCHEMA)
