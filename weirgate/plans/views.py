"""Every registered query as a temporary view, for use from spark.sql."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from weirgate.plans.catalog import QUERIES


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """Creates the views named (all by default) over the tables in sf_dir. Nothing is computed until a view is read,
    but for board and form inputs that are inline."""
    made = list(names if names is not None else QUERIES)
    for name in made:
        QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
    return made
