"""Settings of a run: defaults, a file and overrides merged by key, checked as a whole, and the part that a run records."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Limits and rules of a run.  Names and defaults of what is recorded are those that recorded runs have (fixed values)."""

    baseUrl: str = ""
    outDir: str = "runs"
    storageState: str | None = None
    baseline: str | None = None
    maxStates: int = 60
    maxDepth: int = 6
    maxActionsPerState: int = 40
    maxActionsPerPattern: int = 3
    maxLocalActionRepeats: int = 2
    maxLinkRepeats: int = 3
    followExternalLinks: bool = False
    absorbLocalChanges: bool = True
    allowSubmit: bool = False
    queryParams: str = "ignore"
    structuralParams: tuple[str, ...] = ()
    dataParams: tuple[str, ...] = ()
    pathRules: tuple[dict, ...] = ()
    autoPathRules: bool = True
    autoPathRulesMinSiblings: int = 3
    denyUrl: tuple[str, ...] = ()
    viewport: dict = field(default_factory=lambda: {"width": 1280, "height": 800})
    fill: dict = field(default_factory=dict)


_MERGED = ("viewport", "fill")
_PATHS = ("outDir", "storageState", "baseline")
_CHOICES = {"queryParams": ("ignore", "names", "values")}
_LEAST = {"maxStates": 1, "maxDepth": 0, "maxActionsPerState": 1, "maxActionsPerPattern": 0, "maxLocalActionRepeats": 0, "maxLinkRepeats": 0, "autoPathRulesMinSiblings": 2}
_RECORDED = (
    "maxStates", "maxDepth", "maxActionsPerState", "maxActionsPerPattern", "maxLocalActionRepeats", "maxLinkRepeats", "followExternalLinks", "absorbLocalChanges", "allowSubmit",
    "queryParams", "structuralParams", "dataParams", "pathRules", "autoPathRules", "autoPathRulesMinSiblings", "viewport",
)


def kind_of(x: Any) -> str:
    """How a value's type is named in messages."""
    names = {type(None): "null", bool: "true or false", int: "number", float: "number", str: "text", dict: "object", list: "list", tuple: "list"}
    return names.get(type(x), type(x).__name__)


def regex_problem(pattern: str) -> str | None:
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def problems(values: dict[str, Any]) -> list[str]:
    """Everything that is wrong with the values of a settings file, each with its name."""
    found, defaults = [], dataclasses.asdict(Settings())
    for name, value in values.items():
        if name not in defaults:
            found.append(f"{name}: no such setting")
            continue
        wanted = "text" if name in _PATHS else kind_of(defaults[name])
        if value is not None and kind_of(value) != wanted or value is None and name not in _PATHS:
            found.append(f"{name}: {wanted} is wanted, not {kind_of(value)}")
        elif name in _LEAST and value < _LEAST[name]:
            found.append(f"{name}: at least {_LEAST[name]}")
        elif name in _CHOICES and value not in _CHOICES[name]:
            found.append(f"{name}: one of {', '.join(_CHOICES[name])}")
        elif name == "denyUrl":
            found += [f"{name}[{k}]: {why}" for k, p in enumerate(value) if (why := regex_problem(p))]
        elif name == "pathRules":
            found += [f"{name}[{k}]: {why}" for k, r in enumerate(value) if (why := regex_problem(str(r.get("pattern", ""))))]
    return found


def merged(from_file: dict[str, Any], overrides: dict[str, Any], file_dir: str = ".", cwd: str = ".") -> Settings:
    """Defaults, then the file's values, then overrides that aren't None; objects are merged by key.

    Relative paths are those of the folder that they were given in.  All problems come in one error.
    """
    clean = {k: v for k, v in overrides.items() if v is not None}
    values = dict(from_file) | clean
    wrong = problems(values)
    if wrong:
        raise ValueError("; ".join(wrong))
    for name in _MERGED:
        values[name] = getattr(Settings(), name) | from_file.get(name, {}) | clean.get(name, {})
    for name in _PATHS:
        path = values.get(name, getattr(Settings(), name))
        base = file_dir if name in from_file and name not in clean else cwd
        values[name] = os.path.normpath(os.path.join(base, path)) if path and "://" not in path else path
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def recorded(settings: Settings) -> dict[str, Any]:
    """What a run keeps of its settings: what decides which screens are told apart, and no paths or sign-in data."""
    return {name: getattr(settings, name) for name in _RECORDED} | {"authenticated": bool(settings.storageState)}
