"""Operators written with the DataFrame API over the relations of the graph.

An operator is a function of (r, p): ``r(name)`` gives a relation as a DataFrame, ``p``
the parameters. Beside it stands its SQL over the same relations, written by itself, not
derived from the DataFrame form; the checking engine runs that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dialect import DUCK
from .graph import GRAPH

Read = Callable[[str], DataFrame]


@dataclass
class Frames:
    built: dict[str, tuple[Callable, Callable]] = field(default_factory=dict)

    def op(self, sql: Callable):
        """Registers the decorated function as a query; ``sql(d, p)`` is its reference."""

        def declare(fn: Callable[[Read, object], DataFrame]) -> Callable:
            self.built[fn.__name__] = (fn, sql)
            return fn

        return declare

    def run(self, name: str, params, register: Callable[[SparkSession, str], None]):
        """The operator as a function of a session and a folder of tables."""
        fn = self.built[name][0]

        def query(spark: SparkSession, folder: str) -> DataFrame:
            register(spark, folder)
            return fn(lambda relation: GRAPH.frame(spark, relation, params, folder), params)

        query.__name__, query.__doc__ = name, fn.__doc__
        return query

    def oracle(self, name: str, params) -> str:
        return GRAPH.over(self.built[name][1](DUCK, params), DUCK, params)


FRAMES = Frames()


def place(*order: Column | str, by: str | list[str] = "customer_id") -> Column:
    """Row number inside each group, as a long."""
    return F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)).cast("long")


def total(column: Column, by: str | list[str] = "customer_id") -> Column:
    """An aggregate over each group, on every row of it."""
    return column.over(Window.partitionBy(*([by] if isinstance(by, str) else by)))


def share(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b as a rounded double, null where b is 0."""
    return F.round(a.cast("double") / F.when(b != 0, b), digits)


def rounded(column: Column, digits: int) -> Column:
    """A double rounded as `Spark.rounding` has it."""
    return F.round(column * 10.0**digits, 0) / 10.0**digits
