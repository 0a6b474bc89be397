"""Sources and steps by name: those that come with the engine, and those that users add or install.

A source or step is found, first, among those registered in this process;
then among the entry points (groups ``skein.sources`` and ``skein.steps``) of
installed distributions; then in the modules of the package ``skein_plugins``,
wherever on the path its parts are. Found classes are made once; what is sent
to executors is the object itself, which loads its own module there.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame, SparkSession

from skein.sources.base import KINDS, Function, Source, Step

# Sources that come with the engine.
BUILT_IN = ("yandex", "bing", "baidu", "sogou", "bing_images", "bing_news", "bing_videos", "sogou_images", "sogou_videos", "sogou_wechat", "bilibili", "unsplash")


@dataclass
class Plugin:
    name: str
    kind: str
    description: str
    categories: list[str]
    callback: Callable[[dict], dict] = field(repr=False)


_PLUGINS: dict[str, Plugin] = {}


def register_engine(name: str, kind: str, description: str, categories: list[str], callback: Callable[[dict], dict]) -> None:
    """callback: a query dict in, {"results": [{title, url, snippet or content}]} out."""
    _PLUGINS[name] = Plugin(name, kind, description, categories, callback)


def unregister_engine(name: str) -> bool:
    return _PLUGINS.pop(name, None) is not None


def has_engine(name: str) -> bool:
    return name in _PLUGINS


def list_engines() -> list[str]:
    return [*BUILT_IN, *sorted({*_PLUGINS, *sources()})]


#: The package whose modules are looked through for sources and steps.
PACKAGE = "skein_plugins"
_SOURCES: dict[str, Source] = {}
_STEPS: dict[str, Step] = {}


def register_source(source: Source) -> None:
    _SOURCES[source.name] = source


def register_step(step: Step | Callable[[DataFrame], DataFrame], name: str | None = None, kind: str = "enhancer") -> None:
    """A step object, or a function with a name and a kind."""
    made = step if isinstance(step, Step) else Function(name or step.__name__, kind, step)
    if made.kind not in KINDS:
        raise ValueError(f"a step is one of {', '.join(KINDS)}, not {made.kind}")
    _STEPS[made.name] = made


def _modules(package: str) -> Iterator:
    try:
        found = importlib.import_module(package)
    except ModuleNotFoundError as missing:
        if missing.name != package:
            raise
        return
    for m in pkgutil.iter_modules(found.__path__):
        if not m.name.startswith("_"):
            yield importlib.import_module(f"{package}.{m.name}")


def _found(group: str, wanted: Callable[[object], bool], package: str) -> dict:
    """Objects by name: classes are made, instances taken as they are; those of entry points come before those of modules."""
    candidates = [v for m in _modules(package) for v in vars(m).values() if not inspect.isclass(v) or v.__module__ == m.__name__]
    candidates += [e.load() for e in entry_points(group=group)]
    made = [v() if inspect.isclass(v) and not inspect.isabstract(v) and wanted(v) else v for v in candidates]
    return {v.name: v for v in made if not inspect.isclass(v) and wanted(v)}


def sources(package: str = PACKAGE) -> dict[str, Source]:
    """All sources that users have added or installed, by name."""
    is_source = lambda v: issubclass(v, Source) if inspect.isclass(v) else isinstance(v, Source)
    return _found("skein.sources", is_source, package) | _SOURCES


def steps(package: str = PACKAGE) -> dict[str, Step]:
    is_step = lambda v: callable(v) and getattr(v, "kind", None) in KINDS and bool(getattr(v, "name", "")) and not isinstance(v, Source)
    return _found("skein.steps", is_step, package) | _STEPS


def chain(items: DataFrame, *names: str, package: str = PACKAGE) -> DataFrame:
    """items through steps by name, in the order told."""
    known = steps(package)
    for name in names:
        if name not in known:
            raise KeyError(f"no step {name}; there are {', '.join(sorted(known))}")
        items = items.transform(known[name])
    return items


def responses_to_items(responses: DataFrame, now: Column | None = None, package: str = PACKAGE) -> DataFrame:
    """Items of captured answers of all engines, added sources among them, in one pass."""
    from skein.sources import pages

    return pages.responses_to_items(responses, now, {name: s.parse for name, s in sources(package).items()})


def run_plugin(spark: SparkSession, name: str, queries: DataFrame) -> DataFrame:
    """Items of a registered plugin for each row (query_id, query)."""
    return run_callback(_PLUGINS[name].callback, queries)


def run_callback(callback: Callable[[dict], dict], queries: DataFrame) -> DataFrame:
    """Items that a callback gives for each row (query_id, query), called on the executors."""
    import pandas as pd

    def task(frames):
        for frame in frames:
            rows = []
            for q in frame.itertuples():
                for i, r in enumerate(callback({"query": q.query}).get("results", [])):
                    rows.append((q.query_id, i, r.get("title", ""), r.get("url", ""), r.get("snippet", r.get("content", "")), 1.0, "web"))
            yield pd.DataFrame(rows, columns=["query_id", "pos", "title", "url", "content", "score", "result_type"])

    return queries.select("query_id", "query").mapInPandas(task, "query_id string, pos int, title string, url string, content string, score double, result_type string")
