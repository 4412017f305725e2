"""Workspace and dependency manifests of a checked-out tree; small files, read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import MEMBERS

MARKERS = ("go.mod", "package.json", "composer.json", "pyproject.toml", "setup.py")


@dataclass
class Member:
    id: str
    root: str
    namespaces: list[str] = field(default_factory=list)
    deps: list[str] = field(default_factory=list)


def read_json(path: Path) -> dict:
    try:
        found = json.loads(path.read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def read_text(path: Path) -> str:
    try:
        return path.read_text()
    except OSError:
        return ""


def patterns(root: Path) -> list[str]:
    """Directory patterns that workspace files at the root list."""
    out = re.findall(r"^\s*(?:use\s+)?(\.{1,2}/[^\s)]+|\.)\s*$", read_text(root / "go.work"), re.M)
    out += re.findall(r"^\s*-\s*[\"']?([^\"'\n#]+?)[\"']?\s*$", read_text(root / "pnpm-workspace.yaml"), re.M)
    out += [r["url"] for r in read_json(root / "composer.json").get("repositories", []) if isinstance(r, dict) and r.get("type") == "path" and "url" in r]
    out += read_json(root / "lerna.json").get("packages", [])
    spaces = read_json(root / "package.json").get("workspaces", [])
    out += spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    return list(dict.fromkeys(p.strip().rstrip("/") for p in out if p.strip()))


def namespaces(root: Path) -> list[str]:
    """What a member owns: its Go module, npm name, Composer name and PSR-4 prefixes, Python packages and modules."""
    out = re.findall(r"^module\s+(\S+)", read_text(root / "go.mod"), re.M)
    out += [n for n in [read_json(root / "package.json").get("name")] if n]
    composer = read_json(root / "composer.json")
    out += [n for n in [composer.get("name")] if n] + [k.rstrip("\\") for k in composer.get("autoload", {}).get("psr-4", {}) if k]
    if any((root / m).exists() for m in ("pyproject.toml", "setup.py")):
        at = root / "src" if (root / "src").is_dir() else root
        out += [p.name for p in at.iterdir() if p.is_dir() and (p / "__init__.py").exists()]
        out += [p.stem for p in at.glob("*.py") if p.stem not in ("setup", "conftest", "__init__")]
    return sorted(set(out))


def discover(root: str | Path) -> list[Member]:
    """Members of a workspace: directories that its patterns match and that have a marker of their own. One whose namespaces are a strict subset of another's is part of that one. Ids are unique."""
    top = Path(root).resolve()
    wanted = patterns(top)
    excluded = {d for p in wanted if p.startswith("!") for d in top.glob(p[1:].removeprefix("./"))}
    found: dict[Path, list[str]] = {}
    for p in wanted:
        if p.startswith("!"):
            continue
        p = p.removeprefix("./")
        for d in [top] if p in (".", "") else sorted(top.glob(p)):
            if d.is_dir() and d not in excluded and top in [d, *d.parents] and any((d / m).exists() for m in MARKERS):
                found.setdefault(d, namespaces(d))
    own = {d: ns for d, ns in found.items() if not any(set(ns) < set(o) for e, o in found.items() if e != d)}
    out, used = [], set()
    for d, ns in sorted(own.items()):
        base = re.sub(r"[^a-z0-9_-]+", "-", d.name.lower()).strip("-") or "member"
        name, k = base, 2
        while name in used:
            name, k = f"{base}-{k}", k + 1
        used.add(name)
        out.append(Member(name, str(d.relative_to(top)), ns))
    return out


def merge(authored: list[Member], scanned: list[Member]) -> list[Member]:
    """Authored members, with what they leave empty from scanned ones of the same id or root; new ones come after, by id."""
    clean = lambda r: str(Path(r))
    left, out = list(scanned), []
    for a in authored:
        same = next((s for s in left if s.id == a.id), None) or next((s for s in left if clean(s.root) == clean(a.root)), None)
        if same:
            left.remove(same)
        out.append(Member(a.id, a.root, a.namespaces or (same.namespaces if same else []), a.deps or (same.deps if same else [])))
    return out + sorted(left, key=lambda m: m.id)


def members_table(spark: SparkSession, members: list[Member]) -> DataFrame:
    return spark.createDataFrame([(m.id, m.root, i, m.namespaces, m.deps) for i, m in enumerate(members)], MEMBERS)


def vendored(root: str | Path) -> list[tuple[str, str, str]]:
    """(namespace, version, directory) of dependencies that are in the tree, by Go's vendor list and Composer's lock."""
    top = Path(root)
    out = [(m, v, f"vendor/{m}") for m, v in re.findall(r"^# (\S+) (v\S+)", read_text(top / "vendor/modules.txt"), re.M)]
    out += [(p["name"], p.get("version", ""), f"vendor/{p['name']}") for p in read_json(top / "composer.lock").get("packages", []) if "name" in p]
    return [o for o in out if (top / o[2]).is_dir()]
