"""Settings from arguments, the environment, a .env file and YAML, in this order of weight.

Environment names are ``MILLRACE_<GROUP>__<FIELD>``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

from millrace.errors import SettingsError

PREFIX = "MILLRACE_"


@dataclass(frozen=True)
class App:
    log_level: str = "INFO"
    log_json: bool = True


@dataclass(frozen=True)
class Ingestion:
    window_lines: int = 50
    overlap_lines: int = 5
    ignore_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Storage:
    root_dir: str = "./data"


@dataclass(frozen=True)
class Embeddings:
    provider: str = "hashing"
    model: str = "hashing"
    dimension: int = 768


@dataclass(frozen=True)
class Chat:
    provider: str = "extract"
    model: str = "default"
    temperature: float = 0.2
    max_tokens: int = 2048


@dataclass(frozen=True)
class Evaluation:
    cost_rates_path: str = "config/costs.yaml"
    reports_dir: str = "eval/reports"


@dataclass(frozen=True)
class Settings:
    app: App = field(default_factory=App)
    ingestion: Ingestion = field(default_factory=Ingestion)
    storage: Storage = field(default_factory=Storage)
    embeddings: Embeddings = field(default_factory=Embeddings)
    chat: Chat = field(default_factory=Chat)
    eval: Evaluation = field(default_factory=Evaluation)


def _cast(kind: Any, value: Any, name: str) -> Any:
    try:
        if kind is bool:
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}[str(value).lower()]
        if kind in (int, float, str):
            return kind(value)
        return tuple(value.split(",") if isinstance(value, str) else value)
    except (KeyError, TypeError, ValueError) as error:
        raise SettingsError("a setting that does not hold", {"name": name, "value": value}) from error


def load(yaml_path: str | None = None, env_file: str | None = ".env", environ: dict[str, str] | None = None, **groups: dict[str, Any]) -> Settings:
    layers: list[dict[str, dict[str, Any]]] = []
    if yaml_path and Path(yaml_path).is_file():
        import yaml

        layers.append(yaml.safe_load(Path(yaml_path).read_text()) or {})
    lines = Path(env_file).read_text().splitlines() if env_file and Path(env_file).is_file() else []
    filed = dict(line.split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#"))
    for source in (filed, dict(os.environ if environ is None else environ)):
        layer: dict[str, dict[str, Any]] = {}
        for name, value in source.items():
            if name.upper().startswith(PREFIX) and "__" in name:
                group, key = name[len(PREFIX) :].lower().split("__", 1)
                layer.setdefault(group, {})[key] = value.strip().strip("'\"")
        layers.append(layer)
    layers.append(groups)
    made = {}
    for part in fields(Settings):
        kind = part.default_factory
        hints = get_type_hints(kind)
        merged = {k: v for layer in layers for k, v in (layer.get(part.name) or {}).items() if k in hints}
        made[part.name] = kind(**{k: _cast(hints[k], v, f"{part.name}.{k}") for k, v in merged.items()})
        assert is_dataclass(made[part.name])
    out = Settings(**made)
    if out.embeddings.dimension < 1 or out.chat.max_tokens < 1 or not 0 <= out.chat.temperature <= 2 or not 0 <= out.ingestion.overlap_lines < out.ingestion.window_lines:
        raise SettingsError("a setting out of range")
    return out
