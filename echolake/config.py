"""Settings with defaults and checks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Server:
    host: str = "0.0.0.0"
    port: int = 9000
    threads: int = 0


@dataclass
class Backend:
    url: str = ""
    model: str = ""
    api_key_env: str = ""
    api_key_file: str = ""
    timeout_seconds: int = 60


@dataclass
class Embedding:
    dim: int = 512
    lower_case: bool = True
    pooling: str = "cls"
    tokenizer: str = "wordpiece"


@dataclass
class Cache:
    enabled: bool = True
    max_entries: int = 10_000
    ttl_days: int = 0
    threshold: float = 0.85
    merge_threshold: float = 0.95
    veto: bool = True
    top_k: int = 3

    @property
    def ttl_seconds(self) -> int:
        return self.ttl_days * 86_400


@dataclass
class Filter:
    block_urls: bool = False
    blocked_keywords: list[str] = field(default_factory=list)
    max_input_bytes: int = 0
    max_output_bytes: int = 0


@dataclass
class Cost:
    input_per_1k: float = 0.0
    output_per_1k: float = 0.0


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    backend: Backend = field(default_factory=Backend)
    embedding: Embedding = field(default_factory=Embedding)
    cache: Cache = field(default_factory=Cache)
    filter: Filter = field(default_factory=Filter)
    cost: Cost = field(default_factory=Cost)

    def check(self) -> Config:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(0 < self.server.port < 65_536, "server.port is 1 to 65535")
        need(self.embedding.dim > 0, "embedding.dim is positive")
        need(self.embedding.pooling in ("cls", "mean"), "embedding.pooling is cls or mean")
        need(0 <= self.cache.ttl_days <= 3650, "cache.ttl_days is 0 to 3650")
        need(self.cache.max_entries > 0, "cache.max_entries is positive")
        need(0 <= self.cache.threshold <= 1 and 0 <= self.cache.merge_threshold <= 1, "thresholds are 0 to 1")
        need(self.cost.input_per_1k >= 0 and self.cost.output_per_1k >= 0, "prices are not negative")
        need(self.backend.timeout_seconds > 0, "backend.timeout_seconds is positive")
        return self


def _fill(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    out = kind()
    for k, v in values.items():
        if k in known:
            old = getattr(out, k)
            if is_dataclass(old):
                v = _fill(type(old), v)
            elif isinstance(old, bool) != isinstance(v, bool) or not isinstance(v, (int, float) if isinstance(old, float) else type(old)):
                raise ValueError(f"{k} is a {type(old).__name__}")
            setattr(out, k, v)
    return out


def load(text: str) -> Config:
    """Settings from JSON; what is missing has its default, unknown keys are ignored."""
    return _fill(Config, json.loads(text)).check()


def api_key(backend: Backend, env=os.environ, generic: str = "LLM_API_KEY") -> str:
    """The named variable, else the file, else the generic variable."""
    if backend.api_key_env and env.get(backend.api_key_env):
        return env[backend.api_key_env]
    if backend.api_key_file:
        with open(backend.api_key_file) as f:
            if key := f.read().strip():
                return key
    return env.get(generic, "")
