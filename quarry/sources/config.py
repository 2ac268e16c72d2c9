"""Settings of a scan: defaults, then a file, then the environment, then explicit values."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

MODES = ("smart", "all", "off")


@dataclass(frozen=True)
class Config:
    """The limits of a scan and of its review."""

    max_file_kb: int = 500
    include_tests: bool = False
    review_mode: str = "smart"
    max_findings: int = 40
    max_requests: int = 6
    max_input_tokens: int = 60_000
    max_output_tokens: int = 16_000

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.type == "int" and not (isinstance(v, int) and v > 0):
                raise ValueError(f"{f.name} must be a positive number, not {v!r}")
        if self.review_mode not in MODES:
            raise ValueError(f"review_mode must be one of {', '.join(MODES)}, not {self.review_mode!r}")


def load_config(path: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "QUARRY_", **explicit: object) -> Config:
    """The later source wins; unknown names are an error."""
    known = {f.name: f.type for f in fields(Config)}
    values: dict[str, object] = {}
    if path:
        with open(path, "rb") as f:
            values |= tomllib.load(f)
    for name, kind in known.items():
        text = env.get(prefix + name.upper())
        if text is not None:
            values[name] = int(text) if kind == "int" else text.lower() in ("1", "true", "yes") if kind == "bool" else text
    values |= {k: v for k, v in explicit.items() if v is not None}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Config(), **values)
