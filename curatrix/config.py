"""Configuration: five sections, every key checked, nothing executable."""

import math
import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from datetime import date
from pathlib import Path

from curatrix.functions.text import fingerprint

# What an assessment may call an item.
CATEGORIES = ("portrait", "full_body", "activity", "social", "other")
# How stored scans are made; a change has every file read anew.
PIPELINE = "faces-2"
# The form of a criterion's name, and what two limits are unless they are set.
_NAME = re.compile(r"[a-z][a-z0-9_]{0,39}")
_LIMITS = {"max_per_day": 1, "min_visual_distance": 12}


class ConfigError(ValueError):
    pass


def _within(low: float, high: float, whole: bool = False, step: int = 0):
    return field(metadata={"low": low, "high": high, "whole": whole, "step": step})


def _number(value, whole: bool = False) -> bool:
    kinds = int if whole else (int, float)
    return isinstance(value, kinds) and not isinstance(value, bool) and math.isfinite(value)


class _Section:
    def __post_init__(self) -> None:
        for f in fields(self):
            if not f.metadata:
                continue
            value, m = getattr(self, f.name), f.metadata
            if not _number(value, m["whole"]) or not m["low"] <= value <= m["high"]:
                kind = "a whole number" if m["whole"] else "a number"
                raise ConfigError(f"{f.name} must be {kind} from {m['low']} to {m['high']}")
            if m["step"] and value % m["step"]:
                raise ConfigError(f"{f.name} must be a multiple of {m['step']}")


@dataclass(frozen=True)
class Recognition(_Section):
    threshold: float = _within(-1, 1)
    max_side: int = _within(320, 4096, True, 32)
    threads: int = _within(1, 64, True)
    skip_invalid_references: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if not isinstance(self.skip_invalid_references, bool):
            raise ConfigError("skip_invalid_references must be true or false")


@dataclass(frozen=True)
class Selection(_Section):
    top: int = _within(1, 100, True)
    minimum_score: float = _within(0, 10)
    near_duplicate_distance: int = _within(-1, 64, True)
    diversity_bonus: float = _within(0, 10)
    max_per_day: int = _within(0, 100, True)
    min_visual_distance: int = _within(0, 64, True)
    not_before: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        if not isinstance(self.not_before, str):
            raise ConfigError("not_before must be empty or a date")
        if self.not_before:
            try:
                date.fromisoformat(self.not_before)
            except ValueError as error:
                raise ConfigError("not_before must be empty or a date") from error

    @property
    def first_day(self) -> date | None:
        return date.fromisoformat(self.not_before) if self.not_before else None


@dataclass(frozen=True)
class Assessment(_Section):
    image_size: int = _within(336, 2016, True)
    timeout_seconds: int = _within(10, 3600, True)
    exclude: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if any(not isinstance(x, str) or not x.strip() for x in self.exclude):
            raise ConfigError("exclude must be a list of texts that are not blank")


@dataclass(frozen=True)
class Criterion:
    weight: float
    description: str


@dataclass(frozen=True)
class Config:
    library: str
    references: str
    recognition: Recognition
    selection: Selection
    assessment: Assessment
    criteria: dict[str, Criterion]

    def signature(self, revision: str = "") -> str:
        """What assessments depend on: the rubric's wording, never weights or limits."""
        return fingerprint({
            "revision": revision, "criteria": {k: c.description for k, c in self.criteria.items()},
            "exclude": list(self.assessment.exclude), "image_size": self.assessment.image_size,
        })

    def scan_signature(self, identity_digest: str, revision: str = "") -> str:
        """What scanned rows depend on."""
        return fingerprint({"identity": identity_digest, "max_side": self.recognition.max_side, "pipeline": PIPELINE, "revision": revision})

    @property
    def project(self) -> str:
        """A short name for the pair of folders."""
        return fingerprint({"library": self.library, "references": self.references})[:16]

    def to_dict(self) -> dict:
        return asdict(self)


def _exactly(what: str, value, keys: set[str], defaults: dict | None = None) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"[{what}] must be a table")
    value = (defaults or {}) | value
    if set(value) != keys:
        wrong = sorted(set(value) ^ keys)
        raise ConfigError(f"[{what}] needs exactly {', '.join(sorted(keys))}; look at {', '.join(wrong)}")
    return value


def _folder(what: str, value, base: Path) -> str:
    if not isinstance(value, str) or not value:
        raise ConfigError(f"paths.{what} must name a folder")
    expanded = os.path.expandvars(value)
    if "$" in expanded:
        raise ConfigError(f"paths.{what} has a variable that is not set: {value}")
    path = (base / Path(expanded).expanduser()).resolve()
    if not path.is_dir():
        raise ConfigError(f"paths.{what} is not a folder: {path}")
    return str(path)


def parse(raw: dict, base: Path) -> Config:
    """A configuration from its tables; relative folders start at ``base``."""
    raw = _exactly("config", raw, {"paths", "recognition", "selection", "vision", "criteria"})
    paths = _exactly("paths", raw["paths"], {"library", "references"})
    names = lambda cls: {f.name for f in fields(cls)}
    recognition = _exactly("recognition", raw["recognition"], names(Recognition))
    selection = _exactly("selection", raw["selection"], names(Selection), _LIMITS)
    vision = _exactly("vision", raw["vision"], names(Assessment))
    if not isinstance(vision["exclude"], list):
        raise ConfigError("exclude must be a list of texts that are not blank")
    if not isinstance(raw["criteria"], dict) or not raw["criteria"]:
        raise ConfigError("at least one criterion is needed")
    criteria = {}
    for name, c in raw["criteria"].items():
        if not _NAME.fullmatch(name):
            raise ConfigError(f"{name!r} is no name for a criterion")
        c = _exactly(f"criteria.{name}", c, {"weight", "description"})
        if not _number(c["weight"]) or c["weight"] < 0:
            raise ConfigError(f"the weight of {name} must be a number of 0 or more")
        if not isinstance(c["description"], str) or not c["description"].strip():
            raise ConfigError(f"{name} needs a description")
        criteria[name] = Criterion(c["weight"], c["description"])
    if sum(c.weight for c in criteria.values()) <= 0:
        raise ConfigError("one criterion at least must weigh something")
    return Config(
        _folder("library", paths["library"], base), _folder("references", paths["references"], base), Recognition(**recognition),
        Selection(**selection), Assessment(**vision | {"exclude": tuple(vision["exclude"])}), criteria,
    )


def load(path: str | Path) -> Config:
    path = Path(path).resolve()
    with path.open("rb") as stream:
        return parse(tomllib.load(stream), path.parent)
