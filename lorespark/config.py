"""Settings of a project, from defaults, its configuration file and the environment.

Directories and router settings: environment over file over default. Models and code directories: file over environment
over default.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

CONFIG_FILE = ".lore/config.json"
PREFIX = "LORE_"


@dataclass(frozen=True)
class Config:
    project_root: str
    docs_dir: str = "docs"
    knowledge_dir: str = ".knowledge"
    code_dirs: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    shared_indexes: Mapping[str, str] = field(default_factory=dict)
    embedding_model: str = "text-embedding-3-large"
    llm_model: str = "o3-mini"
    api_key: str = ""
    sdk_cache_ttl_days: int = 7
    enabled: bool = True
    cache_maxsize: int = 128
    cache_ttl_seconds: int = 600
    circuit_breaker_threshold: int = 5
    circuit_breaker_reset_seconds: int = 60
    max_context_tokens: int = 2500
    top_k: int = 5
    freshness_decay_hours: float = 168.0
    similarity_threshold: float = 0.92
    hybrid_confidence_min: float = 0.5
    hybrid_confidence_max: float = 0.85

    def shown(self) -> dict:
        """All settings for display, the key masked."""
        return asdict(self) | {"api_key": f"***{self.api_key[-4:]}" if self.api_key else "(none)"}

    def problems(self) -> list[str]:
        out = [f"{n} does not exist: {p}" for n, p in (("docs_dir", self.docs_dir), *(("code_dirs", d) for d in self.code_dirs)) if not (Path(self.project_root) / p).exists()]
        return out + ([] if self.top_k > 0 else ["top_k must be positive"])


FILE_FIRST = ("embedding_model", "llm_model", "code_dirs")


def _cast(kind: type, value: object) -> object:
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(x for x in (value.split(",") if isinstance(value, str) else value) if x)
    return kind(value)


def load(project_root: str | Path, environ: Mapping[str, str] = os.environ) -> Config:
    """The settings of a project; a missing or invalid file counts as empty, a value that cannot be read as unset."""
    root = Path(project_root)
    try:
        file = json.loads((root / CONFIG_FILE).read_text())
    except (OSError, ValueError):
        file = {}
    file = file if isinstance(file, dict) else {}
    file = {**file, **(file.get("bridge") if isinstance(file.get("bridge"), dict) else {})}
    out: dict[str, object] = {}
    for f in fields(Config):
        if f.name == "project_root":
            continue
        kind = {"str": str, "int": int, "float": float, "bool": bool}.get(str(f.type), tuple if "tuple" in str(f.type) else dict)
        env = environ.get(PREFIX + f.name.upper()) if kind is not dict else None
        sources = (file.get(f.name), env) if f.name in FILE_FIRST else (env, file.get(f.name))
        for value in sources:
            if value in (None, ""):
                continue
            try:
                out[f.name] = _cast(kind, value)
                break
            except (TypeError, ValueError):
                continue
    return Config(str(root), **out)
