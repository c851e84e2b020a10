"""Settings from a TOML file over defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class Config:
    model: str = ""
    dimension: int = 384
    max_tokens: int = 8192
    top_k: int = 100
    cache_hours: int = 24
    warn_share: float = 0.10
    refuse_share: float = 0.30


def load(path: str | None = None) -> Config:
    """Defaults, and what the file's sections say about the known names; unknown names are an error."""
    out = Config()
    if path and Path(path).exists():
        found: dict = {}
        for key, value in tomllib.loads(Path(path).read_text()).items():
            found |= value if isinstance(value, dict) else {key: value}
        known = {f.name for f in fields(Config)}
        if extra := set(found) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        for key, value in found.items():
            setattr(out, key, type(getattr(out, key))(value))
    return out
