"""Settings of engines: files, environment, and what follows from them."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Engines that an HTTP request asks for unless told, by kind.
DEFAULT_ENGINES = ("google", "bing", "baidu", "duckduckgo", "yandex", "brave", "startpage", "qwant")


def load(path: str) -> dict:
    """A TOML or JSON file; others are an error."""
    text, kind = Path(path).read_text(), Path(path).suffix
    if kind == ".toml":
        return tomllib.loads(text)
    if kind == ".json":
        return json.loads(text)
    raise ValueError(f"settings are TOML or JSON, not {kind or path}")


def from_environment(names: list[str], prefix: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Values of PREFIX_NAME that are set."""
    environment = os.environ if environment is None else environment
    return {n: environment[key] for n in names if (key := f"{prefix}_{n}".upper()) in environment}


def problems(settings: dict, rules: list[Callable[[dict], str | None]]) -> list[str]:
    """What the rules, the user's own among them, find wrong."""
    return [p for rule in rules if (p := rule(settings))]


def enabled(engines: DataFrame, category: str | None = None) -> DataFrame:
    """Engines (name, enabled, weight, categories) that are on, of a category."""
    own = engines.where("enabled")
    return own if category is None else own.where(F.array_contains("categories", category))


def weight_sum(engines: DataFrame, category: str | None = None) -> DataFrame:
    return enabled(engines, category).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))


def selected(asked: DataFrame, allowed: list[str], states: DataFrame, now: int) -> DataFrame:
    """query_id, ord and engine of what a search calls: asked (query_id, ord, engine), allowed and not paused (engine, disabled_until)."""
    paused = states.where(F.col("disabled_until") > now).select("engine")
    return asked.where(F.col("engine").isin(allowed)).join(paused, "engine", "left_anti").select("query_id", "ord", "engine")


def query_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def query_from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def _score(parts: list[tuple[Column, int]]) -> Column:
    return sum((F.when(test, n).otherwise(0) for test, n in parts), F.lit(0))


def _of(name: str) -> Column:
    """A setting by its path; settings rows have a column for each."""
    return F.col(f"`{name}`")


def security_score() -> Column:
    """Of 100 points, ten for each thing that is as it should be."""
    safe = (F.lower(_of("general.environment")) == "production") & ~_of("general.debug")
    guarded = F.lower(_of("privacy.fingerprint_protection.protection_level")) != "none"
    tests = [_of("api.auth.enabled"), ~F.contains(_of("server.secret_key"), F.lit("change")), _of("server.tls.enabled"), safe, _of("privacy.enable_tor"), F.size(_of("privacy.proxy_chain")) > 0, guarded]
    return _score([(t, 10) for t in [*tests, _of("api.rate_limit.enabled"), _of("logging.structured"), _of("general.enable_metrics")]])


def performance_score() -> Column:
    """Of 100 points."""
    engines, results = _of("search.max_concurrent_engines"), _of("cache.enable_result_cache")
    varied = _of("privacy.request_timing.max_delay") > _of("privacy.request_timing.min_delay")
    return _score([
        (results, 15), (_of("cache.enable_metadata_cache"), 10), (_of("cache.enable_dns_cache"), 5), (engines >= 5, 10), (engines <= 20, 10), (_of("logging.performance.enabled"), 10), (varied, 10), (_of("cache.compression.enabled"), 10),
        (~_of("search.aggregation.enable_deduplication") | results, 10), (_of("engines.global_settings.enable_monitoring"), 10),
    ])
