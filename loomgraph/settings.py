"""Settings of a repository: its own file, then the environment, then a ``.env`` file, then the defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX, FOLDER, FILE = "LOOMGRAPH_", ".loomgraph", "loomgraph.toml"


@dataclass(frozen=True)
class Settings:
    repo_path: Path = Path(".")
    llm_api_key: str | None = None
    github_token: str | None = None
    max_workers: int = 8
    token_budget: int = 8000
    llm_enrich: bool = False
    log_level: str = "INFO"

    @property
    def folder(self) -> Path:
        return self.repo_path / FOLDER

    @property
    def tables_path(self) -> Path:
        return self.folder / "tables"

    @property
    def snapshot_path(self) -> Path:
        return self.folder / "snapshot"

    @property
    def context_pack_path(self) -> Path:
        return self.folder / "context_pack.json"

    @property
    def notes_path(self) -> Path:
        return self.folder / "session_notes.md"

    @classmethod
    def from_repo(cls, root: str | Path, environ: Mapping[str, str] | None = None) -> Settings:
        """What ``root`` sets; makes its folder."""
        root = Path(root).resolve()
        found = {**_env_file(root / ".env"), **(os.environ if environ is None else environ)}
        known = {f.name: f for f in fields(cls) if f.name != "repo_path"}
        values = {k: _cast(v, known[k].default) for k in known if (v := found.get(PREFIX + k.upper())) is not None}
        if (root / FILE).exists():
            values |= {k: v for k, v in tomllib.loads((root / FILE).read_text(encoding="utf-8")).items() if k in known}
        out = cls(repo_path=root, **values)
        out.folder.mkdir(exist_ok=True)
        return out


def _env_file(path: Path) -> dict[str, str]:
    lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
    pairs = (line.removeprefix("export ").split("=", 1) for line in map(str.strip, lines) if "=" in line and not line.startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def _cast(value: str, default: object) -> object:
    if isinstance(default, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return int(value) if isinstance(default, int) else value
