"""Settings merged from several places, and seeds."""

from __future__ import annotations

import os
import random
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import numpy as np

_seed: int | None = None


def merged(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """Later layers win; mappings are merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, Mapping) else v
    return out


def from_file(path: Path) -> dict[str, Any]:
    if not path.exists():
        return {}
    import yaml

    return yaml.safe_load(path.read_text()) or {}


def load(name: str, defaults: Mapping[str, Any] | None = None, command_line: Mapping[str, Any] | None = None, script: Mapping[str, Any] | None = None, project: Path | None = None) -> dict[str, Any]:
    """defaults < the user's configuration folder < the project's file < command line < script."""
    home = Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config"))
    return merged(defaults, from_file(home / name / "config.yaml"), from_file(project or Path(f"{name}.yaml")), command_line, script)


def initialize_random(seed: int | None = None) -> int:
    """Seeds Python and numpy; without a seed, draws one. Returns it."""
    global _seed
    _seed = random.SystemRandom().getrandbits(32) if seed is None else seed
    random.seed(_seed)
    np.random.seed(_seed)
    return _seed


def get_seed() -> int:
    return initialize_random() if _seed is None else _seed
