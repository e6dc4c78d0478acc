"""Run settings from the environment: malformed values fall back to defaults, and problems are listed, not raised."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from weirgate.functions.vocab import THRESHOLD

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    resume: str = ""
    profile: str = ""
    history: str = ""
    threshold: float = THRESHOLD
    limit: int = 10
    top_terms: int = 25
    verbose: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "WEIRGATE_") -> Settings:
        values = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "").strip()
            if not raw:
                continue
            kind = type(f.default)
            if kind is bool:
                values[f.name] = raw.lower() in TRUE
                continue
            try:
                values[f.name] = kind(raw)
            except ValueError:
                continue
        return cls(**values)

    def problems(self) -> list[str]:
        found = []
        if self.resume and not Path(self.resume).exists():
            found.append(f"no file at {self.resume}")
        if not 0 < self.threshold <= 1:
            found.append("the threshold must be over 0 and at most 1")
        return found
