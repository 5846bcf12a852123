"""Test reports (JUnit and TRX) and raw logs as rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Outcomes that count as failed, extensions that are read, names of formats.
FAILED = {"failed", "error", "timeout", "aborted"}
EXTENSIONS = ("log", "txt", "out", "xml", "trx", "gz")
_FORMATS = {"": "auto", "auto": "auto", "log": "log", "raw": "log", "text": "log", "junit": "junit", "xml": "junit", "trx": "trx", "dotnet": "trx"}
FIELDS = ("name", "classname", "message", "details", "method", "assembly", "full_name")
FAILURES = T.StructType([T.StructField("source", T.StringType()), *[T.StructField(f, T.StringType()) for f in FIELDS], T.StructField("seq", T.IntegerType())])


def parse_format(text: str | None) -> str | None:
    return _FORMATS.get((text or "").strip().lower())


def _root(content: str | ET.Element) -> ET.Element:
    if isinstance(content, ET.Element):
        return content
    if "<!DOCTYPE" in content or "<!ENTITY" in content:
        raise ET.ParseError("document types are not read")
    return ET.fromstring(content.lstrip("\ufeff").strip())


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ET.Element | None) -> str | None:
    return None if e is None else "".join(e.itertext())


def sniff(path: str | None, content: str) -> tuple[str, str | ET.Element]:
    """The format and what is to be read: the parsed root where that had to be looked at."""
    if (path or "").lower().endswith(".trx"):
        return "trx", content
    if content.lstrip("\ufeff \t\r\n").startswith("<"):
        try:
            root = _root(content)
        except ET.ParseError:
            return "log", content
        if _local(root).lower() == "testrun":
            return "trx", root
        if _local(root) in ("testsuites", "testsuite"):
            return "junit", root
    return "log", content


def detect_format(path: str | None, content: str) -> str:
    """``trx``, ``junit`` or ``log``: by extension, then by the root of well-formed XML."""
    return sniff(path, content)[0]


def assembly_name(v: str | None) -> str | None:
    name = (v or "").strip().replace("\\", "/").rsplit("/", 1)[-1]
    if name.lower().endswith((".dll", ".exe")):
        name = name[:-4]
    return name or None


def _failure(name: str, cls: str | None, message: str, details: str | None, method: str | None = None, assembly: str | None = None) -> dict:
    return {"name": name, "classname": cls, "message": message, "details": (details or "").strip() or None, "method": method, "assembly": assembly, "full_name": f"{cls}.{name}" if (cls or "").strip() else name}


def junit_failures(content: str | ET.Element) -> list[dict]:
    out: list[dict] = []

    def walk(e: ET.Element, suite: str | None) -> None:
        kind = _local(e)
        if kind == "testsuite":
            suite = e.get("name")
        if kind == "testcase":
            fault = next((c for c in e if _local(c) in ("failure", "error")), None)
            if fault is not None:
                body = _text(fault) or ""
                out.append(_failure(e.get("name", "(unknown)"), e.get("classname"), fault.get("message", body.strip()), body, assembly=assembly_name(suite)))
        for c in e:
            walk(c, suite)

    walk(_root(content), None)
    return out


def trx_failures(content: str | ET.Element) -> list[dict]:
    root = _root(content)
    child = lambda e, n: None if e is None else next((c for c in e if _local(c) == n), None)
    tests: dict[str, tuple] = {}
    for t in (e for e in root.iter() if _local(e) == "UnitTest"):
        m = child(t, "TestMethod")
        if t.get("id") and m is not None:
            cls = m.get("className")
            cls = cls.split(",", 1)[0].strip() if (cls or "").strip() else None
            tests.setdefault(t.get("id").lower(), (cls, m.get("name"), assembly_name(m.get("codeBase") or t.get("storage"))))
    out = []
    for r in (e for e in root.iter() if _local(e) == "UnitTestResult"):
        if (r.get("outcome") or "").lower() not in FAILED:
            continue
        info = next((e for e in r.iter() if _local(e) == "ErrorInfo"), None)
        cls, method, assembly = tests.get((r.get("testId") or "").lower(), (None, None, None))
        name = r.get("testName", "(unknown)")
        if cls and name.startswith(cls + "."):
            name = name[len(cls) + 1 :]
        out.append(_failure(name, cls, (_text(child(info, "Message")) or "").strip(), _text(child(info, "StackTrace")), method, assembly))
    for i in (e for e in root.iter() if _local(e) == "RunInfo"):
        text = (_text(child(i, "Text")) or "").strip()
        if (i.get("outcome") or "").lower() == "error" and text:
            out.append(_failure("Test run aborted", None, text, None))
    return out


def _parse(forced: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for source, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not content:
                    continue
                kind, body = (forced, content) if forced else sniff(source, content)
                if kind == "log":
                    continue
                try:
                    found = trx_failures(body) if kind == "trx" else junit_failures(body)
                except ET.ParseError:
                    if forced:
                        raise
                    continue  # a report by its name only
                rows += [(source, *(f[k] for k in FIELDS), i) for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 8 else pa.string()) for k in range(9)], names=FAILURES.names)

    return run


def test_failures(files: DataFrame, forced: str | None = None) -> DataFrame:
    """``(source, name, classname, message, details, method, assembly, full_name, seq)`` of files
    ``(source, content)``: one row per failing test, ``seq`` its place in the report.

    Malformed XML fails if the format is forced and is an ordinary log if it was only sniffed.
    Null and empty contents and plain logs give no rows.
    """
    return files.select("source", "content").mapInArrow(_parse(forced), FAILURES)


def unit_text(f: dict) -> str:
    """What is analysed of a failing test: its name, then message and details unless blank."""
    parts = [f"FAILED: {f['full_name']}", *(x.strip(" ") for x in (f["message"], f["details"]) if x and x.strip(" "))]
    return "\n".join(parts) + "\n"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for source, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kind, body = sniff(source, content or "")
            if kind == "log":
                rows.append((source, content, 0))
                continue
            try:
                found = trx_failures(body) if kind == "trx" else junit_failures(body)
            except ET.ParseError:
                continue  # a report by its name only
            rows += [("::".join(x for x in (source, f["full_name"]) if x is not None), unit_text(f), i) for i, f in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 2 else pa.string()) for k in range(3)], names=["source", "text", "seq"])


def units(files: DataFrame) -> DataFrame:
    """``(source, text, seq)``: a raw log is one unit, a report one unit per failing test. Every
    file is read and parsed once; a null content is a log without text."""
    return files.select("source", "content").mapInArrow(_units, "source string, text string, seq int")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``(source, content)`` of files and of directories (recursively, known extensions only);
    ``.gz`` is unpacked by its name. Wildcards stand in file names only."""
    for p in paths:
        head = p.rsplit("/", 1)[0] if "/" in p else ""
        if "*" in head or "?" in head:
            raise ValueError(f"wildcard in a directory name: {p}")
    df = spark.read.option("recursiveFileLookup", "true").text(list(paths), wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))
    return df.where(F.lower(F.substring_index("source", ".", -1)).isin(*EXTENSIONS))


def read_selection(spark: SparkSession, report: str) -> tuple[DataFrame, DataFrame]:
    """``(skipped (test, project), projects (project, assembly))`` of a test-selection report, a
    JSON document of schema version 1; the first project of a test wins."""
    import json

    o = json.loads(report)
    if not isinstance(o, dict) or not isinstance(o.get("schemaVersion"), int) or isinstance(o.get("schemaVersion"), bool):
        raise ValueError("no selection report: it has no schemaVersion")
    if o["schemaVersion"] != 1:
        raise ValueError(f"schema {o['schemaVersion']} is not supported")
    if not isinstance(o.get("skippedTests"), list):
        raise ValueError("the report lists no skipped tests")
    tests: dict[str, str] = {}
    for p in o["skippedTests"]:
        for t in p.get("tests") or []:
            if isinstance(t, str) and t:
                tests.setdefault(t, p.get("project") or "")
    projects = [(p["project"], p.get("assembly") or None) for p in o.get("skippedProjects") or [] if p.get("project")]
    return spark.createDataFrame(list(tests.items()), "test string, project string"), spark.createDataFrame(projects, "project string, assembly string")
