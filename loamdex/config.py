"""Settings, kept as a TOML file in the library's home folder."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from loamdex.errors import ConfigError


@dataclass
class Defaults:
    model: str = "nomic-embed-text-v2"
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_file_size: int = 100 * 1024 * 1024
    jobs: int = 0


@dataclass
class Ignore:
    patterns: list[str] = field(default_factory=lambda: ["node_modules", ".git", "__pycache__", "*.pyc", "target/", ".loamdex/"])


@dataclass
class Search:
    max_results: int = 10
    hybrid_alpha: float = 0.7
    rerank: bool = True


@dataclass
class Server:
    host: str = "127.0.0.1"
    port: int = 7820


def home() -> Path:
    return Path(os.environ.get("LOAMDEX_HOME", Path.home() / ".loamdex"))


@dataclass
class Config:
    index_name: str = "default"
    default: Defaults = field(default_factory=Defaults)
    ignore: Ignore = field(default_factory=Ignore)
    search: Search = field(default_factory=Search)
    server: Server = field(default_factory=Server)

    @classmethod
    def load(cls, path: str | os.PathLike | None = None) -> Config:
        """The settings of the file, defaults where it or a key is missing; unknown keys are left alone."""
        file = Path(path) if path else home() / "config.toml"
        config = cls()
        if not file.is_file():
            return config
        try:
            given = tomllib.loads(file.read_text())
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{file}: {e}") from e
        config.index_name = given.get("index_name", config.index_name)
        for section in ("default", "ignore", "search", "server"):
            part = getattr(config, section)
            for f in fields(part):
                if f.name in given.get(section, {}):
                    setattr(part, f.name, given[section][f.name])
        return config

    def index_dir(self) -> Path:
        return home() / "indexes" / self.index_name

    def models_dir(self) -> Path:
        return home() / "models"

    def workers(self) -> int:
        return self.default.jobs or os.cpu_count() or 4

    def _at(self, key: str) -> tuple[object, str]:
        section, _, name = key.rpartition(".")
        holder = getattr(self, section, None) if section else self
        if holder is None or key.startswith("ignore") or not hasattr(holder, name) or isinstance(getattr(holder, name), (Defaults, Ignore, Search, Server)):
            raise ConfigError(f"Unknown config key: {key}")
        return holder, name

    def get(self, key: str) -> str | None:
        """The value of a dotted key, None if there is no such key."""
        try:
            value = getattr(*self._at(key))
        except (ConfigError, TypeError):
            return None
        return str(value).lower() if isinstance(value, bool) else str(value)

    def set(self, key: str, value: str) -> None:
        """Set a dotted key from text. The index name and reranking can't be set here."""
        if key in ("index_name", "default.max_file_size", "search.rerank"):
            raise ConfigError(f"Unknown config key: {key}")
        holder, name = self._at(key)
        try:
            setattr(holder, name, type(getattr(holder, name))(value))
        except ValueError as e:
            raise ConfigError("Invalid number") from e

    def toml(self) -> str:
        def text(v: object) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, list):
                return "[" + ", ".join(map(text, v)) + "]"
            return str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

        lines = [f"index_name = {text(self.index_name)}"]
        for section, part in asdict(self).items():
            if isinstance(part, dict):
                lines += ["", f"[{section}]", *(f"{k} = {text(v)}" for k, v in part.items())]
        return "\n".join(lines) + "\n"

    def save(self, path: str | os.PathLike | None = None) -> None:
        """Write the file whole or not at all."""
        file = Path(path) if path else home() / "config.toml"
        file.parent.mkdir(parents=True, exist_ok=True)
        part = file.with_name(f"{file.name}.{os.getpid()}.part")
        part.write_text(self.toml())
        os.replace(part, file)
