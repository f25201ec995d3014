"""Configuration: YAML files, hashes, environment overrides and the two epochs."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path
from typing import Any

PREFIX = "GROUNDSHIFT_"
EPOCHS = ("t1", "t2")


def find_root(start: Path, marker: str = "pyproject.toml", most: int = 10) -> Path:
    """The nearest folder at or above start, up to `most` levels, that holds the marker or a .git folder."""
    for folder in [start, *start.parents][: most + 1]:
        if (folder / marker).exists() or (folder / ".git").exists():
            return folder
    raise FileNotFoundError(f"no {marker} above {start}")


def load_config(path: str | Path, make_folders: bool = False) -> dict[str, Any]:
    """The file's settings with absolute paths, a 12-digit hash of its bytes and overrides of top-level keys."""
    import yaml

    raw = Path(path).read_bytes()
    cfg: dict[str, Any] = yaml.safe_load(raw) or {}
    base = Path(path).resolve().parent
    for name, value in (cfg.get("paths") or {}).items():
        cfg["paths"][name] = str(base / value)
        if make_folders:
            Path(cfg["paths"][name]).mkdir(parents=True, exist_ok=True)
    for name, value in os.environ.items():
        if name.startswith(PREFIX):
            cfg[name.removeprefix(PREFIX).lower()] = value
    return cfg | {"_hash": hashlib.sha256(raw).hexdigest()[:12]}


def config_hash(cfg: dict[str, Any]) -> str:
    return cfg["_hash"]


def get_epoch(cfg: dict[str, Any], key: str) -> dict[str, Any]:
    if key not in EPOCHS:
        raise KeyError(f"epoch must be one of {EPOCHS}, not {key!r}")
    return cfg["epochs"][key]
