"""A graph of named relations; a query is the chain of relations that its result needs.

A relation is declared once, as SQL over other relations, with parameters. `Graph.sql`
renders it with what it needs as common table expressions; `Graph.frame` gives it to
Catalyst as one plan, so filters and column pruning reach the scans.

Relations that many others read are staged: they are written once into the shared
folder, per session, feed and parameters, and read from there, which cuts lineage (a
lost executor recomputes one stage) and spares the six sources from running again for
every query above them. A table of the feed that is rewritten makes new stages;
`Graph.forget` drops all, which is needed only after files inside a table's folder changed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialise
from .dialect import DUCK, SPARK, Spark

Template = Callable[..., str]


@dataclass
class Graph:
    relations: dict[str, Template] = field(default_factory=dict)
    queries: dict[str, str] = field(default_factory=dict)
    staged: set[str] = field(default_factory=set)
    #: staged relations that a function makes in Spark, (r, p) -> DataFrame; their SQL is the reference only
    made: dict[str, Callable] = field(default_factory=dict)
    #: made relations that only read what is written already; they are not written again
    thin: set[str] = field(default_factory=set)
    _stages: dict[tuple, DataFrame] = field(default_factory=dict)
    #: one for each stage, taken while it is made; a stage asks only for those below it
    _locks: dict[tuple, Lock] = field(default_factory=dict)

    def relation(self, fn: Template) -> Template:
        """Declares a relation under the function's name; ``fn(d, p)`` gives its SQL."""
        self.relations[fn.__name__] = fn
        return fn

    def query(self, fn: Template) -> Template:
        """Declares a relation that is also a registered query."""
        self.queries[fn.__name__] = fn.__doc__ or ""
        return self.relation(fn)

    def stage(self, *names: str) -> None:
        """Marks relations to be written once."""
        self.staged.update(names)

    def forget(self) -> None:
        self._stages.clear()

    def needs(self, name: str, d: Spark, p, cut: bool = False) -> list[str]:
        """The relations below ``name``, in an order in which each follows what it reads; ``cut``: nothing below staged ones."""
        order: list[str] = []

        def visit(x: str, above: tuple[str, ...]) -> None:
            if x in above:
                raise ValueError(f"{x} reads itself")
            if x not in order:
                if not (cut and above and x in self.staged):
                    for y in self.reads(x, d, p):
                        visit(y, (*above, x))
                order.append(x)

        visit(name, ())
        return order

    def reads(self, name: str, d: Spark, p) -> list[str]:
        found = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", self.relations[name](d, p))
        return [x for x in dict.fromkeys(found) if x in self.relations and x != name]

    def _render(self, name: str, names: list[str], d: Spark, p) -> str:
        body = ",\n".join(f"{x} AS (\n{self.relations[x](d, p).strip()}\n)" for x in names)
        # a literal with a point is a decimal of few digits in Spark SQL; with an exponent it is a double everywhere
        return d.rounding(re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", f"WITH {body}\nSELECT * FROM {name}"))

    def sql(self, name: str, d: Spark, p) -> str:
        return self._render(name, self.needs(name, d, p), d, p)

    def frame(self, spark: SparkSession, name: str, p, feed: str) -> DataFrame:
        """The relation as a DataFrame; the feed's tables are registered in the session."""
        if name in self.staged:
            return self._stage(spark, name, p, feed)
        names = self.needs(name, SPARK, p, cut=True)
        self._name(spark, [x for x in names if x in self.staged], p, feed)
        return spark.sql(self._render(name, [x for x in names if x not in self.staged], SPARK, p))

    def _stage(self, spark: SparkSession, name: str, p, feed: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, feed, state_of(spark, feed), p, name)
        with self._locks.setdefault(key, Lock()):
            if key not in self._stages:
                if name in self.made:
                    df = self.made[name](lambda x: self.frame(spark, x, p, feed), p)
                else:
                    names = self.needs(name, SPARK, p, cut=True)
                    self._name(spark, [x for x in names if x in self.staged and x != name], p, feed)
                    df = spark.sql(self._render(name, [x for x in names if x not in self.staged or x == name], SPARK, p))
                self._stages[key] = df if name in self.thin else materialise(df, name)
            return self._stages[key]

    def _name(self, spark: SparkSession, staged: list[str], p, feed: str) -> None:
        """Makes the stages and gives their names to them in the session."""
        for x, df in zip(staged, together(lambda x: self._stage(spark, x, p, feed), *staged), strict=True):
            df.createOrReplaceTempView(x)

    def over(self, select: str, d: Spark, p) -> str:
        """A statement over relations, with all that it needs in front."""
        asked = [x for x in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", select)) if x in self.relations]
        names: list[str] = []
        for x in asked:
            names += [y for y in self.needs(x, d, p) if y not in names]
        body = "".join(f"{x} AS (\n{self.relations[x](d, p).strip()}\n),\n" for x in names)
        return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", f"WITH RECURSIVE {body}the_result AS (\n{select.strip()}\n)\nSELECT * FROM the_result")

    def oracle(self, name: str, p) -> str:
        return self.sql(name, DUCK, p)


def together(read: Callable[[str], DataFrame], *names: str) -> list[DataFrame]:
    """The relations ``names``, their stages made at the same time: the tasks of one fill the cores that another leaves free."""
    if len(names) < 2:
        return [read(name) for name in names]
    inherit = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())  # a thread of threads has no active session
    with ThreadPoolExecutor(len(names)) as threads:
        return [x.result() for x in [threads.submit(inherit(read), name) for name in names]]


def state_of(spark: SparkSession, feed: str) -> int:
    """A number that changes when a table of the feed is rewritten, added or removed: its names, sizes and times, read through Spark's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(feed)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hash(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)))


GRAPH = Graph()
