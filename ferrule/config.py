"""Configuration: roots with profiles, ignore rules, models, refresh; read from and written to TOML."""

from __future__ import annotations

import os
import posixpath
import tomllib
from dataclasses import dataclass, field

from .fixed_values import DEFAULT_FLOOR, DEFAULT_LIMIT, PROFILE_TOKENS, REFRESH_SECONDS
from .functions.models import FLOORS


def expand_path(path: str, home: str | None = None, cwd: str | None = None) -> str:
    """A leading ~ is the home folder; the rest is made absolute and freed of . and .. parts."""
    home = home or os.path.expanduser("~")
    if path == "~" or path.startswith("~/"):
        path = home + path[1:]
    return posixpath.normpath(path if path.startswith("/") else posixpath.join(cwd or os.getcwd(), path))


@dataclass
class Root:
    path: str
    profile: str = "content"

    def __post_init__(self):
        if self.profile not in PROFILE_TOKENS:
            raise ValueError(f"no profile named {self.profile!r}; known: {', '.join(PROFILE_TOKENS)}")


@dataclass
class Config:
    roots: list[Root] = field(default_factory=list)
    model: str = "hashing-64"
    reranker: str | None = None
    limit: int = DEFAULT_LIMIT
    min_similarity: float | None = None
    refresh: str = "daily"
    device: str = "cpu"
    extra_ignores: list[str] = field(default_factory=list)
    unignore: list[str] = field(default_factory=list)
    hidden: bool = False
    max_file_mb: int = 100
    max_read_kb: int = 64
    media: bool = False
    symlinks: bool = False
    places: str | None = None

    def __post_init__(self):
        if self.refresh not in REFRESH_SECONDS:
            raise ValueError(f"no refresh named {self.refresh!r}; known: {', '.join(REFRESH_SECONDS)}")
        if self.device not in ("cpu", "auto", "gpu"):
            raise ValueError(f"no device named {self.device!r}; known: cpu, auto, gpu")

    def deepest_root(self, path: str) -> Root | None:
        """The longest root that holds a path."""
        holding = [r for r in self.roots if path == r.path or path.startswith(r.path.rstrip("/") + "/")]
        return max(holding, key=lambda r: len(r.path), default=None)

    def profile_for(self, path: str) -> str | None:
        root = self.deepest_root(path)
        return root.profile if root else None

    def floor(self) -> float:
        return self.min_similarity if self.min_similarity is not None else FLOORS.get(self.model, DEFAULT_FLOOR)


def from_dict(data: dict) -> Config:
    return Config(**data | {"roots": [Root(**r) for r in data.get("roots", [])]})


def load(path: str) -> Config:
    with open(path, "rb") as f:
        return from_dict(tomllib.load(f))


def save(config: Config, path: str) -> None:
    def value(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, list):
            return "[" + ", ".join(value(x) for x in v) + "]"
        return str(v) if isinstance(v, int | float) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    plain = {k: v for k, v in vars(config).items() if k != "roots" and v is not None}
    lines = [f"{k} = {value(v)}" for k, v in plain.items()]
    for r in config.roots:
        lines += ["", "[[roots]]", f"path = {value(r.path)}", f"profile = {value(r.profile)}"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
