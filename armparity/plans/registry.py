"""Registry of checked queries: a Spark callable plus, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from armparity.plans import study


@dataclass(frozen=True)
class Source:
    """Where a query reads from: the given tables and the study views over them."""

    spark: SparkSession
    sf_dir: str
    _views: dict = field(default_factory=dict, compare=False)

    def table(self, name: str) -> DataFrame:
        return study.table(self.spark, self.sf_dir, name)

    def once(self, build: Callable[[Source], DataFrame]) -> DataFrame:
        """A frame several parts of one query share, built once."""
        if build not in self._views:
            self._views[build] = build(self)
        return self._views[build]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = study.view(self.spark, self.sf_dir, name)
        return self._views[name]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(Source) -> DataFrame`` under ``name``.

    ``oracle`` is DuckDB text; when it uses study views their ``WITH`` clause is put in
    front, so the text continues with ``, more AS (...)`` or ``SELECT``.
    """

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = (study.duck(*views) + "\n" if views else "") + oracle.strip()
        return fn

    return wrap
