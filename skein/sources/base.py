"""What a source and a step over its items are, for those who write their own."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import SPACE

# Fixed value: most bytes of a query.
MOST_BYTES = 1000


@dataclass(frozen=True)
class Abilities:
    """What a source can be asked for."""

    max_page_size: int = 100
    time_range: bool = False
    parameters: tuple[str, ...] = ()


class Source(ABC):
    """A source by name: requests are built from query dicts, captured answers are parsed to rows.

    A subclass is a plain object that can be pickled: ``parse`` runs on executors.
    """

    name: str = ""
    kind: str = "web"
    description: str = ""
    categories: tuple[str, ...] = ("general",)
    abilities: Abilities = Abilities()

    @abstractmethod
    def build_request(self, query: Mapping) -> str:
        """The address to ask; query: query, page, page_size and parameters."""

    @abstractmethod
    def parse(self, body: str) -> list[dict]:
        """title, url, content and perhaps metadata (a dict) of each result of an answer."""

    def problem(self, query: Column, page_size: Column, time_range: Column, parameters: Column) -> Column:
        """Why the source refuses a query, or null; parameters: a map."""
        told = F.array(*map(F.lit, self.abilities.parameters)).cast("array<string>")
        other = F.array_except(F.map_keys(parameters), told)
        return (
            F.when(F.coalesce(F.regexp_replace(query, SPACE, ""), F.lit("")) == "", "empty query")
            .when(F.octet_length(query) > MOST_BYTES, "query too long")
            .when(page_size > self.abilities.max_page_size, F.lit(f"page size over {self.abilities.max_page_size}"))
            .when(time_range.isNotNull() & F.lit(not self.abilities.time_range), "no time range")
            .when(F.size(other) > 0, F.concat(F.lit("no parameter "), F.array_min(other)))
        )


@runtime_checkable
class Step(Protocol):
    """A parser, filter, sorter, enhancer or formatter: a DataFrame in, another out."""

    name: str
    kind: str

    def __call__(self, items: DataFrame) -> DataFrame: ...


#: The order in which steps of these kinds make sense.
KINDS = ("parser", "filter", "enhancer", "sorter", "formatter")


@dataclass(frozen=True)
class Function:
    """A step made of a function."""

    name: str
    kind: str
    function: object

    def __call__(self, items: DataFrame) -> DataFrame:
        return self.function(items)
