"""Rule packs from YAML and the search path for them."""

from __future__ import annotations

from pathlib import Path

from faultloom.operators.rules import Rule, override

try:
    import yaml
except ImportError:  # packs may also come as tables
    yaml = None


def parse_pack(text: str) -> list[Rule]:
    """Rules of one YAML list. Unknown keys are ignored; rules without id, and enabled rules
    without a pattern, are dropped; a disabled stub stays, so it can silence another."""
    if yaml is None:
        raise RuntimeError("YAML is not available")
    out = []
    for i, r in enumerate(yaml.safe_load(text) or []):
        on = r.get("enabled", True)
        if not str(r.get("id") or "").strip() or on and not str(r.get("match") or "").strip():
            continue
        more = tuple(r.get("ecosystems") or ())
        out.append(Rule(str(r["id"]), str(r.get("match") or ""), r.get("ecosystem", "generic"), more, r.get("category", "general"), r.get("title", ""), float(r.get("confidence", 0.5)), r.get("fix", ""), r.get("docs"), r.get("severity"), r.get("notMatch"), r.get("requires"), bool(on), i))
    return out


def load_packs(*directories: str | Path, base: list[Rule] | None = None) -> list[Rule]:
    """Packs of all directories over ``base``; later directories and files win; unreadable packs
    count as empty; a directory named twice is read once."""
    tiers, seen = [base or []], set()
    for d in map(Path, directories):
        if d.resolve() in seen:
            continue
        seen.add(d.resolve())
        for f in sorted(d.glob("*.y*ml"), key=lambda p: p.name):
            try:
                tiers.append(parse_pack(f.read_text()))
            except Exception:  # noqa: BLE001
                continue
    return override(*tiers)


BUILT_IN = Path(__file__).resolve().parents[1] / "packs"


def built_in() -> list[Rule]:
    """The rules that come with the library, a pack for each ecosystem."""
    return load_packs(BUILT_IN)


def search_path(home: str | Path | None, start: str | Path, configured: list[str] = (), given: list[str] = (), folder: str = ".build-rules") -> list[Path]:
    """Directories that hold packs, least important first: the user's, those found on the way up
    from ``start`` (the nearest last), configured ones, given ones. Each is named once."""
    here = Path(start).resolve()
    up = [p / folder for p in (*reversed(here.parents), here)]
    own = [Path(home) / folder] if home else []
    out: list[Path] = []
    for p in [*own, *up, *map(Path, configured), *map(Path, given)]:
        q = p.expanduser().resolve()
        if q.is_dir() and q not in out:
            out.append(q)
    return out


def append_rule(path: str | Path, rule: dict, force: bool = False) -> None:
    """Add a drafted rule to a pack file; the same id is replaced only when forced."""
    p = Path(path)
    held = (yaml.safe_load(p.read_text()) or []) if p.exists() else []
    same = [r for r in held if str(r.get("id", "")).lower() == rule["id"].lower()]
    if same and not force:
        raise ValueError(f"{rule['id']} exists")
    p.write_text(yaml.safe_dump([r for r in held if r not in same] + [rule], sort_keys=False, allow_unicode=True))
