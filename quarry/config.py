"""Configuration: defaults, a TOML file found upward from a folder, explicit choices over both; and what to run."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field

#: Files that mark a project's root, and those that hold a configuration (fixed values).
ROOT_MARKERS = ("setup.py", "pyproject.toml", "setup.cfg", ".git", "requirements.txt")
FILE, SECTION = "quarry.toml", "quarry"
ANALYSES = ("complexity", "dead_code", "clones", "cbo", "lcom", "dependencies", "communities", "mock_data", "injection")


@dataclass(frozen=True)
class Config:
    """What can be set. Numbers of 0 in a file or a request mean 'not set', as they do for limits: unlimited."""

    include: tuple[str, ...] = ("**/*.py",)
    exclude: tuple[str, ...] = ("test_*.py", "*_test.py", "**/tests/**", "**/test/**", "**/testing/**", "**/migrations/**")
    max_complexity: int = 10
    min_complexity: int = 1
    max_function_sloc: int = 100
    cognitive_threshold: int = 25
    nesting_threshold: int = 7
    dead_code_severity: str = "warning"
    clone_threshold: float = 0.65
    clone_min_lines: int = 10
    clone_min_nodes: int = 20
    clone_types: tuple[int, ...] = (1, 2, 4)
    max_cycles: int = 0
    mock_severity: str = "warning"
    mock_keywords: tuple[str, ...] = ()
    mock_domains: tuple[str, ...] = ()
    injection_severity: str = "warning"
    constructor_parameters: int = 5
    style: str = "layered"
    strict: bool = False
    layers: dict[str, list[str]] = field(default_factory=dict)
    rules: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    resolution: float = 1.0
    community_min_size: int = 1


def project_root(paths: list[str]) -> str:
    """The nearest folder with a marker, from what all paths share upward; else what they share."""
    tops = [os.path.abspath(p) if os.path.isdir(p) else os.path.dirname(os.path.abspath(p)) for p in paths] or [os.getcwd()]
    shared = now = os.path.commonpath(tops)
    while True:
        if any(os.path.exists(os.path.join(now, m)) for m in ROOT_MARKERS):
            return now
        up = os.path.dirname(now)
        if up == now:
            return shared
        now = up


def find(folder: str) -> str | None:
    """The nearest configuration upward: a file of its own, or a project file with a section; not beyond a repository's root."""
    now = os.path.abspath(folder)
    while True:
        own, project = os.path.join(now, FILE), os.path.join(now, "pyproject.toml")
        if os.path.isfile(own):
            return own
        if os.path.isfile(project) and section(project):
            return project
        up = os.path.dirname(now)
        if os.path.exists(os.path.join(now, ".git")) or up == now:
            return None
        now = up


def section(path: str) -> dict:
    with open(path, "rb") as f:
        data = tomllib.load(f)
    return data.get("tool", {}).get(SECTION, {}) if os.path.basename(path) == "pyproject.toml" else data


def _flat(data: dict) -> dict:
    """Tables other than layers and rules are prefixes of names: [clone] threshold is clone_threshold."""
    known = {f.name for f in dataclasses.fields(Config)}
    out = {}
    for k, v in data.items():
        if isinstance(v, dict) and k not in known:
            out |= {f"{k}_{n}": x for n, x in _flat(v).items()} | {n: x for n, x in v.items() if n in known}
        else:
            out[k] = v
    return out


def merged(base: Config, *layers: dict) -> Config:
    """Later layers win; None, 0 and empty values are not set. Unknown names are ignored."""
    known = {f.name: f for f in dataclasses.fields(Config)}
    now = {}
    for layer in layers:
        for k, v in _flat(layer).items():
            if k in known and v not in (None, 0, "", [], {}, ()) or k in known and v is False:
                now[k] = tuple(v) if isinstance(v, list) and isinstance(getattr(base, k), tuple) else v
    return dataclasses.replace(base, **now)


def load(path: str | None = None, folder: str = ".", **explicit) -> Config:
    """Defaults, then the file (``path``, or the one that ``find`` finds from it or ``folder``), then what is given here."""
    if path and not os.path.exists(path):
        raise FileNotFoundError(path)
    found = path if path and os.path.isfile(path) else find(path or folder)
    return merged(Config(), section(found) if found else {}, explicit)


def chosen(select: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> list[str]:
    """The analyses to run: those selected (default all) without those skipped; unknown names are an error."""
    if bad := [n for n in (*select, *skip) if n not in ANALYSES]:
        raise ValueError(f"unknown analyses: {', '.join(bad)}")
    return [n for n in ANALYSES if (not select or n in select) and n not in skip]
