"""Named queries, each paired with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tenderloom.plans import tables as tb

Plan = Callable[["tb.Tables"], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    views: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(tb.Tables(spark, sf_dir))

    def oracle(self) -> str | None:
        return None if self.sql is None else tb.with_views(self.sql, self.views)


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()) -> Callable[[Plan], Plan]:
    """Register a plan over `Tables` under `name`, with its SQL twin if one exists.

    `views` names the stand-in views the SQL refers to.
    """
    names = (views,) if isinstance(views, str) else tuple(views)

    def keep(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, plan, sql, names)
        return plan

    return keep
