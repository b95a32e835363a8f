"""Engine: a Spark session, a dialect and a catalog answering SQL text with DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import REFERENCE, Dialect, load_dialect
from .errors import BindError, RunError, SqlError
from .plans.binder import Binder
from .sources.catalog import Catalog
from .sql.parser import parse
from .sql.tree import Query


class Engine:
    """functions, operators: NAME -> fn(columns, semantics) -> Column, for names that no built-in has.
    effects: text_eq, text_neq (left, right, semantics) and text_in_pattern (operand, pattern, semantics, case_sensitive),
    each returning a Column, or None to fall back. passes: (tree, semantics) -> tree, run in order before binding.
    max_recursive_rows: a recursive query with more rows fails; by default none does.
    """

    def __init__(self, spark: SparkSession, dialect: Dialect | str = REFERENCE, catalog: Catalog | dict[str, DataFrame] | None = None, *, functions: dict[str, Callable] | None = None, operators: dict[str, Callable] | None = None, effects: dict[str, Callable] | None = None, passes: list[Callable] | None = None, max_recursive_rows: int | None = None):
        self.spark, self.max_recursive_rows = spark, max_recursive_rows
        self.dialect = load_dialect(dialect) if isinstance(dialect, str) else dialect
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog(catalog or {})
        self.functions, self.operators, self.effects, self.passes = functions, operators, effects, list(passes or [])

    def parse(self, sql: str) -> Query:
        return parse(sql, self.dialect)

    def sql(self, text: str) -> DataFrame:
        return self.run_tree(self.parse(text))

    def run_tree(self, tree: Query) -> DataFrame:
        """A tree made by parse() or by hand."""
        for p in self.passes:
            tree = p(tree, self.dialect.semantics)
            if tree is None:
                raise RunError(f"the pass {getattr(p, '__name__', p)} returned nothing")
        binder = Binder(self.spark, self.dialect, self.catalog.get, self.functions, self.operators, self.effects, self.max_recursive_rows)
        try:
            r = binder.query(tree, {})
            return r.df.select(*(F.col(c.internal).alias(c.name) for c in r.cols))
        except PySparkException as e:
            raise BindError(str(e).split("\n")[0]) from e

    def rows(self, text: str) -> list[dict[str, Any]]:
        """The whole result as dicts, for clients; errors carry the stage at which they came up, those of the JVM too."""
        df = self.sql(text)
        try:
            return [r.asDict() for r in df.collect()]
        except (PySparkException, Py4JError) as e:
            raise RunError(str(e).split("\n")[0]) from e


__all__ = ["Engine", "SqlError"]
