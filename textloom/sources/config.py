"""Experiment configuration: TOML -> checked records -> a ``runs`` table (SRC-2, SRC-10, CT-1 to CT-6)."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    """The configuration is wrong; the message says where."""


@dataclass(frozen=True)
class Field:
    """What a key may hold: its type, whether it must be there, and a range."""

    kind: type
    required: bool = True
    default: Any = None
    least: float | None = None
    choices: tuple[str, ...] | None = None


STRATEGIES, MODES, PROVIDERS = ("fixed", "structure"), ("top_k", "token_budget"), ("gemini", "openai_compat", "offline")
SETTINGS = {
    "document": Field(str), "answer_key": Field(str), "results_dir": Field(str), "cache_dir": Field(str),
    "k": Field(int, least=1), "retrieve_n": Field(int, least=1), "token_budget": Field(int, least=1),
}
EMBEDDING = {
    "provider": Field(str, choices=("gemini", "offline")), "model": Field(str), "dimensions": Field(int, least=1), "document_template": Field(str), "query_template": Field(str),
    "api_key_env": Field(str, required=False), "requests_per_minute": Field(int, least=1), "tokens_per_minute": Field(int, least=1), "batch_size": Field(int, least=1),
}
GENERATION = {"active": Field(str), "temperature": Field(float, least=0)}
LLM = {"provider": Field(str, choices=PROVIDERS), "model": Field(str), "base_url": Field(str, required=False), "api_key_env": Field(str, required=False), "requests_per_minute": Field(int, required=False, default=10, least=1)}
RUN = {"id": Field(str), "strategy": Field(str, choices=STRATEGIES), "retrieval": Field(str, choices=MODES), "generate": Field(bool, required=False, default=True)}
PARAMS = {
    "fixed": {"size_chars": Field(int, least=1), "overlap_chars": Field(int, least=0)},
    "structure": {"min_tokens": Field(int, least=0), "max_tokens": Field(int, least=1), "overlap_tokens": Field(int, least=0), "prefix": Field(bool)},
}
RUN_SCHEMA = "run_id string, strategy string, retrieval string, generate boolean, size_chars int, overlap_chars int, min_tokens int, max_tokens int, overlap_tokens int, prefix boolean"


def checked(table: Any, fields: dict[str, Field], where: str) -> dict[str, Any]:
    """The values of a table, or an error that names the key that is missing, mistyped, out of range or unknown."""
    if not isinstance(table, dict):
        raise ConfigError(f"{where}: a table is expected")
    unknown = sorted(set(table) - set(fields))
    if unknown:
        raise ConfigError(f"{where}: unknown keys: {', '.join(unknown)}")
    out = {}
    for name, want in fields.items():
        if name not in table:
            if want.required:
                raise ConfigError(f"{where}: {name} is missing")
            out[name] = want.default
            continue
        value = table[name]
        numeric = want.kind is float and isinstance(value, (int, float))
        if isinstance(value, bool) != (want.kind is bool) or not (numeric or isinstance(value, want.kind)):
            raise ConfigError(f"{where}: {name} must be of type {want.kind.__name__}")
        if want.least is not None and value < want.least:
            raise ConfigError(f"{where}: {name} must be at least {want.least}")
        if want.choices and value not in want.choices:
            raise ConfigError(f"{where}: {name} must be one of {', '.join(want.choices)}")
        out[name] = value
    return out


@dataclass(frozen=True)
class Config:
    settings: dict[str, Any]
    embedding: dict[str, Any]
    generation: dict[str, Any]
    llm: dict[str, dict[str, Any]]
    runs: list[dict[str, Any]] = field(default_factory=list)

    @property
    def profile(self) -> dict[str, Any]:
        return self.llm[self.generation["active"]]


def parse(raw: dict[str, Any]) -> Config:
    """A checked configuration."""
    sections = ("settings", "embedding", "generation", "llm", "runs")
    unknown = sorted(set(raw) - set(sections))
    if unknown:
        raise ConfigError(f"unknown sections: {', '.join(unknown)}")
    for name in sections:
        if name not in raw:
            raise ConfigError(f"section {name} is missing")
    settings = checked(raw["settings"], SETTINGS, "settings")
    if settings["retrieve_n"] < settings["k"]:
        raise ConfigError("settings: retrieve_n must be at least k")
    embedding = checked(raw["embedding"], EMBEDDING, "embedding")
    for name in ("document_template", "query_template"):
        if "{text}" not in embedding[name]:
            raise ConfigError(f"embedding: {name} must contain {{text}}")
    generation = checked(raw["generation"], GENERATION, "generation")
    if not isinstance(raw["llm"], dict):
        raise ConfigError("llm: tables of profiles are expected")
    llm = {name: checked(table, LLM, f"llm.{name}") for name, table in raw["llm"].items()}
    for name, profile in llm.items():
        if profile["provider"] == "openai_compat" and not profile["base_url"]:
            raise ConfigError(f"llm.{name}: base_url is missing")
    if generation["active"] not in llm:
        raise ConfigError(f"generation: active profile {generation['active']} is not defined")
    if not isinstance(raw["runs"], list) or not raw["runs"]:
        raise ConfigError("runs: at least one run is expected")
    runs = []
    for k, table in enumerate(raw["runs"]):
        where = f"runs[{k}]"
        strategy = table.get("strategy") if isinstance(table, dict) else None
        run = checked(table, RUN | PARAMS.get(strategy, {}), where)
        if strategy == "fixed" and run["overlap_chars"] >= run["size_chars"]:
            raise ConfigError(f"{where}: overlap_chars must be below size_chars")
        if strategy == "structure" and run["min_tokens"] > run["max_tokens"]:
            raise ConfigError(f"{where}: min_tokens must not be over max_tokens")
        runs.append(run)
    ids = [r["id"] for r in runs]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise ConfigError(f"runs: duplicate ids: {', '.join(twice)}")
    return Config(settings, embedding, generation, llm, runs)


def load(path: str) -> Config:
    with open(path, "rb") as f:
        try:
            return parse(tomllib.load(f))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e


def runs_table(spark: SparkSession, config: Config) -> DataFrame:
    """One row per run: all runs can then go through one plan."""
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r["id"] if n == "run_id" else r.get(n) for n in names) for r in config.runs], RUN_SCHEMA)


def secret(name: str) -> str:
    """An API key from the environment, asked for only when a call is about to be made."""
    value = os.environ.get(name, "").strip()
    if not value:
        raise ConfigError(f"{name} is not set")
    return value
