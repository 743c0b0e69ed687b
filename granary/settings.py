"""Settings from the environment or a file of NAME=value lines, typed and checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "GRANARY_"
MODES = ("vector", "keyword", "hybrid")


class SettingsError(ValueError):
    """A setting has a value that it can't have."""


@dataclass(frozen=True)
class Settings:
    """Defaults of requests, chunks and providers. A provider is `none`, or has a name and needs a key."""

    retrieval_mode: str = "hybrid"
    top_k: int = 5
    rrf_k: int = 60
    prompt_version: str = "evidence-v1"
    chunk_target: int = 600
    chunk_overlap: int = 50
    embedding_provider: str = "none"
    embedding_model: str = "hashing"
    embedding_key: str = ""
    generation_provider: str = "none"
    generation_model: str = ""
    generation_key: str = ""
    request_timeout: float = 30.0

    def __post_init__(self) -> None:
        faults = [
            (self.retrieval_mode not in MODES, "retrieval_mode"),
            (not 1 <= self.top_k <= 20, "top_k"),
            (self.rrf_k < 1, "rrf_k"),
            (self.chunk_target < 1 or not 0 <= self.chunk_overlap < self.chunk_target, "chunk_overlap"),
            (self.request_timeout <= 0, "request_timeout"),
        ]
        if bad := [name for wrong, name in faults if wrong]:
            raise SettingsError(f"bad value of {', '.join(bad)}")

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, file: str | None = None) -> Settings:
        """The environment goes before the file, and both before the defaults; empty values count as not given."""
        named: dict[str, str] = {}
        if file and Path(file).exists():
            for line in Path(file).read_text(encoding="utf-8").splitlines():
                name, eq, value = line.partition("=")
                if eq and not name.lstrip().startswith("#"):
                    named[name.strip().upper()] = value.strip().strip("\"'")
        named |= {k.upper(): v for k, v in (os.environ if env is None else env).items()}
        given = {}
        for f in fields(cls):
            if value := named.get(f"{PREFIX}{f.name}".upper()):
                try:
                    given[f.name] = type(f.default)(value)
                except ValueError as e:
                    raise SettingsError(f"bad value of {f.name}") from e
        return cls(**given)

    def has_embedding_credentials(self) -> bool:
        return self.embedding_provider == "hashing" or self.embedding_provider != "none" and bool(self.embedding_key)

    def has_generation_credentials(self) -> bool:
        return self.generation_provider != "none" and bool(self.generation_key)

    def embedding_model_name(self) -> str | None:
        """What chunks are labelled with; None without a provider."""
        return None if self.embedding_provider == "none" else f"{self.embedding_provider}/{self.embedding_model}"
