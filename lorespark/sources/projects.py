"""Projects on the driver's disk: discovery, registry, status flags, confined reads, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

from lorespark.config import CONFIG_FILE
from lorespark.sources.files import load_state, save_state


def discover(folder: str | Path) -> list[str]:
    """The folders below a folder that hold a project configuration, once each."""
    return sorted({str(p.parent.parent) for p in Path(folder).rglob(CONFIG_FILE)})


def flags(project: str | Path, knowledge: str = ".knowledge") -> dict[str, bool]:
    p = Path(project)
    return {"exists": p.exists(), "has_index": (p / knowledge / "index").exists(), "has_config": (p / CONFIG_FILE).exists()}


class Registry:
    """Named projects in a state file."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.projects: dict[str, dict] = load_state(path, {"projects": {}})["projects"]

    def add(self, name: str, path: str, description: str = "") -> None:
        self.projects[name] = {"path": path, "description": description}
        save_state(self.path, {"projects": self.projects})

    def remove(self, name: str) -> bool:
        found = self.projects.pop(name, None) is not None
        save_state(self.path, {"projects": self.projects})
        return found

    def listed(self) -> Iterator[dict]:
        for name, p in sorted(self.projects.items()):
            yield {"name": name, **p, **flags(p["path"])}


def read_confined(root: str | Path, path: str, limit: int = 100_000) -> str:
    """A text file below root; links and .. that lead outside are refused."""
    top = Path(root).resolve()
    full = (top / path).resolve()
    if not full.is_relative_to(top):
        raise ValueError(f"{path} is outside the project")
    return full.read_text(encoding="utf-8", errors="replace")[:limit]


def fingerprint(paths: list[str]) -> str:
    """A key that changes when one of the files does: their paths and modification times."""
    marks = [f"{p}:{Path(p).stat().st_mtime_ns}" if Path(p).exists() else f"{p}:missing" for p in paths]
    return hashlib.sha256("|".join(marks).encode()).hexdigest()


def docs_changed(changed: list[str], folder: str = "docs") -> bool:
    """Whether a commit's files call for a new index."""
    return any(p == folder or p.startswith(folder.rstrip("/") + "/") for p in changed)
