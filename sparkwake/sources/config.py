"""The tool's own configuration: which runtime names are which services, and which are ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

FILE = "sparkwake.config.json"


@dataclass
class Config:
    mapped: dict[str, str] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()


def load(root: str, file: str = FILE) -> Config:
    """The file's `runtime.map` and `runtime.ignore`; other keys are left alone, no file is no configuration, and one that
    cannot be read is an error that names it."""
    path = Path(root, file)
    if not path.is_file():
        return Config()
    try:
        runtime = json.loads(path.read_text()).get("runtime") or {}
        mapped, ignored = runtime.get("map") or {}, runtime.get("ignore") or []
        if not all(isinstance(x, str) for x in (*mapped, *mapped.values(), *ignored)):
            raise ValueError("names are strings")
    except (ValueError, AttributeError) as error:
        raise ValueError(f"{path}: {error}") from error
    return Config(mapped, tuple(ignored))
