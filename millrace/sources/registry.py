"""Connectors: a plug-in contract, a Spark data source over captured batches, and a registry that never fails as a whole."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.store import first_rows

# What a site says when it asks to slow down.
RATE_LIMIT_MARKS = ("429", "rate limit", "too many", "quota", "plan")
# Most postings of one call.
CAPS = {"linkedin": 250, "indeed": 100, "google": 50}


class RateLimitError(Exception):
    """A site asks to slow down."""


class JobSource(ABC):
    """A connector: a name, whether it can be used, and a fetch of raw postings."""

    name: str

    @abstractmethod
    def fetch(self, spark: SparkSession, terms: list[tuple[str, str]]) -> DataFrame:
        """Raw postings for pairs of term and place."""

    def is_available(self) -> bool:
        """Whether the source can be asked."""
        return True


class CapturedSource(JobSource):
    """A source that replays captured rows of one site."""

    def __init__(self, name: str, rows: DataFrame):
        self.name, self.rows = name, rows

    def fetch(self, spark: SparkSession, terms: list[tuple[str, str]]) -> DataFrame:
        """All captured rows of the site."""
        return self.rows.where(F.col("source") == self.name)


class Registry:
    """Sources by name; a later one of the same name takes its place."""

    def __init__(self) -> None:
        self.sources: dict[str, JobSource] = {}

    def register(self, source: JobSource) -> None:
        """Add a source."""
        self.sources[source.name] = source

    def fetch_all(self, spark: SparkSession, terms: list[tuple[str, str]], names: list[str] | None = None) -> tuple[DataFrame | None, list[tuple[str, str, str | None]]]:
        """(postings of all sources with ``source_order``, [(name, status, error)]); unknown names are left out, a source that fails only fails itself."""
        parts, status = [], []
        for order, name in enumerate(names if names is not None else list(self.sources)):
            source = self.sources.get(name)
            if source is None:
                continue
            try:
                if not source.is_available():
                    status.append((name, "error", "not available"))
                    continue
                parts.append(source.fetch(spark, terms).withColumn("source_order", F.lit(order)))
                status.append((name, "ok", None))
            except Exception as e:  # noqa: BLE001
                limited = isinstance(e, RateLimitError) or any(m in str(e).lower() for m in RATE_LIMIT_MARKS)
                status.append((name, "rate_limited" if limited else "error", str(e)))
        return (reduce(DataFrame.unionByName, parts) if parts else None), status


def first_urls(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The first row of each url by ``seq``; rows with a blank url all stay."""
    blank = F.coalesce(F.trim("url"), F.lit("")) == ""
    return first_rows(rows.where(~blank), keys, seq).unionByName(rows.where(blank))


def term_location_pairs(spark: SparkSession, terms: list[str], locations: list[str]) -> DataFrame:
    """Every term with every place, terms outside; both are short lists of the configuration."""
    pairs = [(k * len(locations) + j, t, p) for k, t in enumerate(terms) for j, p in enumerate(locations)]
    return spark.createDataFrame(pairs, "seq int, term string, location string")


def load_yaml(path: str) -> dict:
    """A configuration file; empty if it is missing or broken."""
    try:
        return yaml.safe_load(Path(path).read_text()) or {}
    except (OSError, yaml.YAMLError):
        return {}


class _Group(InputPartition):
    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


class _CapturedReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[_Group]:
        import pyarrow.parquet as pq

        files = sorted(Path(self.path).glob("*.parquet")) if Path(self.path).is_dir() else [Path(self.path)]
        return [_Group(str(f), k) for f in files for k in range(pq.ParquetFile(f).num_row_groups)]

    def read(self, partition: _Group) -> Iterator:
        import pyarrow.parquet as pq

        yield from pq.ParquetFile(partition.path).read_row_group(partition.group, columns=self.columns).to_batches()


class CapturedBatch(DataSource):
    """``spark.read.format("captured_batch").load(path)``: a captured batch, one partition a row group."""

    @classmethod
    def name(cls) -> str:
        return "captured_batch"

    def schema(self) -> str:
        return "id string, title string, company string, location string, source string, url string"

    def reader(self, schema) -> _CapturedReader:
        return _CapturedReader(self.options["path"], [f.name for f in schema.fields])
