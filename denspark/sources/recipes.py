"""Preparing datasets: fetch, validate, prepare, publish, with cleanup on failure, over Spark readers and writers."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from denspark.errors import RECIPE

# The phases in order, and the schemes of sources.
PHASES = ("fetch", "validate", "prepare", "publish")
SCHEMES = ("https://", "s3://", "file://")


@dataclass(frozen=True, order=True)
class RecipeVersion:
    """major.minor.patch"""

    major: int
    minor: int
    patch: int

    @classmethod
    def parse(cls, text: str) -> RecipeVersion:
        m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", text)
        if not m:
            raise RECIPE["INVALID_NAME"](f"not a version: {text!r}")
        return cls(*map(int, m.groups()))


@dataclass(frozen=True)
class SourceUrl:
    """Where a dataset comes from; checksums aren't supported."""

    url: str
    checksum: str | None = None

    def __post_init__(self):
        if not any(self.url.startswith(s) and len(self.url) > len(s) for s in SCHEMES):
            raise RECIPE["INVALID_NAME"](f"not a source: {self.url!r}")
        if self.checksum:
            raise RECIPE["CHECKSUM_UNSUPPORTED"]("checksums aren't supported")


@dataclass(frozen=True)
class DatasetInfo:
    name: str
    version: RecipeVersion
    sources: tuple[SourceUrl, ...] = ()


@dataclass(frozen=True)
class Manifest:
    """What was published: path and rows of each role."""

    info: DatasetInfo
    roles: dict[str, tuple[str, int]] = field(default_factory=dict)


class Fetcher(Protocol):
    def fetch(self, url: SourceUrl) -> DataFrame: ...


class Publisher(Protocol):
    def publish(self, info: DatasetInfo, tables: dict[str, DataFrame]) -> Manifest: ...


@dataclass
class BinaryFetcher:
    """Files as rows (path, content), by Spark's reader."""

    spark: SparkSession

    def fetch(self, url: SourceUrl) -> DataFrame:
        return self.spark.read.format("binaryFile").load(url.url)


@dataclass
class ParquetPublisher:
    """One Parquet folder for each role under ``root``."""

    root: str

    def publish(self, info: DatasetInfo, tables: dict[str, DataFrame]) -> Manifest:
        roles = {}
        for role, df in tables.items():
            path = f"{self.root}/{info.name}/{info.version.major}.{info.version.minor}.{info.version.patch}/{role}"
            df.write.mode("overwrite").parquet(path)
            roles[role] = (path, df.sparkSession.read.parquet(path).count())
        return Manifest(info, roles)


class Recipe(ABC):
    """Four phases; each gets what the one before returned."""

    @abstractmethod
    def info(self) -> DatasetInfo: ...

    @abstractmethod
    def fetch(self, fetcher: Fetcher): ...

    @abstractmethod
    def validate(self, fetched): ...

    @abstractmethod
    def prepare(self, validated) -> dict[str, DataFrame]: ...

    def publish(self, tables: dict[str, DataFrame], publisher: Publisher) -> Manifest:
        return publisher.publish(self.info(), tables)

    def cleanup(self, completed: str | None) -> None:
        """Called after a failure with the last phase that ended well."""


def run_recipe(recipe: Recipe, fetcher: Fetcher, publisher: Publisher) -> Manifest:
    """Runs the phases; a failure is reported by phase after cleanup, whose own failure comes first."""
    value, completed = None, None
    steps = (lambda _: recipe.fetch(fetcher), recipe.validate, recipe.prepare, lambda x: recipe.publish(x, publisher))
    for phase, step in zip(PHASES, steps, strict=True):
        try:
            value = step(value)
        except Exception as e:
            try:
                recipe.cleanup(completed)
            except Exception as worse:
                raise RECIPE["CLEANUP"](f"cleanup after {phase}: {worse}", phase=phase) from worse
            raise RECIPE[phase.upper()](str(e), phase=phase) from e
        completed = phase
    return value
