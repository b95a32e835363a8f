"""Names and their DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Its schema is read once an application and path, since that takes a job; its files are listed anew each time.

    A table that changes its columns under the same path needs another application, or forget().
    """
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def forget() -> None:
    """Schemas are read anew from now on."""
    _SCHEMAS.clear()


class Catalog:
    """A DataFrame, or a function that makes one when first asked for, by name. Names are looked up without regard to case."""

    def __init__(self, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self._tables = {k.lower(): v for k, v in (tables or {}).items()}

    @staticmethod
    def parquet(spark: SparkSession, folder: str, names: Iterable[str]) -> Catalog:
        """One Parquet file or folder a table: <folder>/<name>.parquet, opened when first used."""
        return Catalog({n: (lambda n=n: opened(spark, f"{folder.rstrip('/')}/{n}.parquet")) for n in names})

    def put(self, name: str, table: DataFrame) -> None:
        self._tables[name.lower()] = table

    def get(self, name: str) -> DataFrame | None:
        found = self._tables.get(name.lower())
        if callable(found) and not isinstance(found, DataFrame):
            found = self._tables[name.lower()] = found()
        return found

    def names(self) -> list[str]:
        return sorted(self._tables)

    def schema(self, name: str) -> StructType:
        df = self.get(name)
        if df is None:
            raise KeyError(name)
        return df.schema

    def describe(self) -> str:
        return "\n".join(f"{n}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.schema(n).fields)})" for n in self.names())
