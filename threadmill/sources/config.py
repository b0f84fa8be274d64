"""Settings as a TOML file: sections of typed values with defaults."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Store:
    path: str = "store"
    owner_name: str = ""


@dataclass
class Api:
    key: str = ""
    base_url: str = ""
    embedding_model: str = ""
    chat_model: str = ""
    embedding_dims: int = 384
    concurrency: int = 4


@dataclass
class Search:
    depth: str = "balanced"
    top_k: int = 15
    use_graph: bool = True


@dataclass
class Config:
    store: Store = field(default_factory=Store)
    api: Api = field(default_factory=Api)
    search: Search = field(default_factory=Search)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """A missing file gives the defaults; unknown sections and keys are errors."""
        config = cls()
        file = Path(path)
        if file.exists():
            for section, values in tomllib.loads(file.read_text(encoding="utf-8")).items():
                for key, value in values.items():
                    config.set(f"{section}.{key}", value)
        return config

    def set(self, name: str, value) -> None:
        """Sets ``section.key``, converting texts to the type of the setting."""
        section, _, key = name.partition(".")
        part = getattr(self, section, None)
        known = {f.name: type(getattr(part, f.name)) for f in fields(part)} if part is not None else {}
        if key not in known:
            raise KeyError(name)
        kind = known[key]
        if kind is bool and isinstance(value, str):
            if value.lower() not in ("true", "false"):
                raise ValueError(f"{name} is true or false")
            value = value.lower() == "true"
        if kind is bool and not isinstance(value, bool):
            raise ValueError(f"{name} is true or false")
        setattr(part, key, kind(value))

    def save(self, path: str | Path) -> None:
        def shown(value) -> str:
            if isinstance(value, bool):
                return str(value).lower()
            if isinstance(value, int):
                return str(value)
            return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

        lines = []
        for section, values in asdict(self).items():
            lines += [f"[{section}]", *(f"{key} = {shown(value)}" for key, value in values.items()), ""]
        Path(path).write_text("\n".join(lines), encoding="utf-8")
