"""Settings as TOML. [A21]"""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    xml_dir: str = ""
    store: str = ""
    tsv: str = ""
    mapping: str = ""
    titles: str = ""
    files: list[str] = field(default_factory=list)

    def with_defaults(self) -> Settings:
        """Paths that are not set, beside the store: <store>-new and <store>-reference for what a run writes and compares."""
        base = self.store.rstrip("/") or "fragments"
        return Settings(**asdict(self) | {"store": base, "tsv": self.tsv or f"{base}-new.tsv"})

    @property
    def reference_tsv(self) -> str:
        return f"{self.store.rstrip('/') or 'fragments'}-reference.tsv"


def load(path: str | Path) -> Settings:
    raw = tomllib.loads(Path(path).read_text())
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in raw.items() if k in known})


def load_or_default(path: str | Path) -> Settings:
    return load(path) if Path(path).exists() else Settings()


def save(settings: Settings, path: str | Path) -> None:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"{k} = [{', '.join(map(quote, v))}]" if isinstance(v, list) else f"{k} = {quote(v)}" for k, v in asdict(settings).items()]
    Path(path).write_text("\n".join(lines) + "\n")
