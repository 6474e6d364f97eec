"""The statement splitter as a table function of SQL: SELECT * FROM split_statements('...')."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..shipping import ship


class SplitStatements:
    def eval(self, script: str):
        from gaugework.plans.statements import changes, split

        for k, s in enumerate(split(script or "")):
            for change in changes(s.sql):
                yield k, s.line, s.sql, change.kind, change.table, change.column


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("split_statements", udtf(SplitStatements, returnType="k int, line int, sql string, kind string, table string, column string"))
