"""Registry of queries: name, Spark job and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under `name`; `covers` lists the inventory ids it exercises."""

    def add(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            # times without a zone are compared as UTC, whatever zone the session came with
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return job(spark, sf_dir)

        QUERIES[name] = Query(name, in_utc, sql, tuple(covers.split()))
        return job

    return add


def load_all() -> dict[str, Query]:
    from cohortline.plans import catalog

    catalog.register()
    return QUERIES
