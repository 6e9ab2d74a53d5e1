"""Settings with their limits, from a JSON file, the environment, a command line and a dictionary, in rising order."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_results: int = 50
    response_rows: int = 10
    response_snippet_chars: int = 8000
    response_json_bytes: int = 16384
    max_file_chars: int = 1_500_000
    context_lines: int = 5
    max_chunk_chars: int = 30_000
    embedding_batch: int = 32
    embedding_dims: int = 768
    stale_branch_days: int = 14
    profile: str = "Fast"

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, int) and v < (0 if f.name == "context_lines" else 1):
                raise ValueError(f"{f.name} must be positive, not {v}")
        if self.profile not in ("Fast", "Hybrid", "Semantic"):
            raise ValueError(f"profile must be Fast, Hybrid or Semantic, not {self.profile}")


def load(path: str | None = None, prefix: str = "PLUMBLINE_SET_", argv: list[str] | None = None, **given: object) -> Settings:
    """argv: --name value or --name=value for any setting, with - for _; others are left alone."""
    known = {f.name: f.type for f in fields(Settings)}
    out: dict[str, object] = {}
    if path:
        with open(path) as f:
            out.update({k: v for k, v in json.load(f).items() if k in known})
    for name, kind in known.items():
        if (v := os.environ.get(prefix + name.upper())) is not None:
            out[name] = int(v) if kind == "int" else v
    words = [w for a in argv or [] for w in (a.split("=", 1) if a.startswith("--") else [a])]
    for option, value in zip(words, words[1:]):
        name = option.removeprefix("--").replace("-", "_")
        if option.startswith("--") and name in known:
            out[name] = int(value) if known[name] == "int" else value
    out.update({k: v for k, v in given.items() if v is not None})
    return Settings(**out)
