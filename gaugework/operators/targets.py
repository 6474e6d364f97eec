"""Disposable places for generated tables: a database that is made for a purpose and dropped after it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import Shape
from . import hydrate


class Ephemeral:
    """A database of its own, dropped with all its tables when the block ends, whatever happens in it.

    ::

        with Ephemeral(spark) as target:
            rows = target.load(shape, seed=7)
            target.table("orders").count()
    """

    def __init__(self, spark: SparkSession, prefix: str = "gaugework"):
        self.spark, self.name = spark, f"{prefix}_{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Ephemeral:
        self.spark.sql(f"CREATE DATABASE `{self.name}`")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.name}` CASCADE")

    def _table(self, name: str) -> str:
        return f"`{self.name}`.`{name.replace('.', '__')}`"

    def load(self, shape: Shape, **options) -> dict[str, int]:
        """Generate and save all tables; rows by table."""
        out = {}
        for name, df in hydrate.generate(self.spark, shape, **options).items():
            df.write.saveAsTable(self._table(name))
            out[name] = self.table(name).count()
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def tables(self, shape: Shape) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in shape.tables}
