"""Small literal tables that Spark and DuckDB both get."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession



def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files give fewer tasks than that (one small file); any other table as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SQL = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def _type(t: str) -> str:
    inner = re.fullmatch(r"array<(.+)>", t)
    return _type(inner[1]) + "[]" if inner else _SQL[t]


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x)


class Fixture:
    """Rows under a DDL schema; `df` for Spark, `cte` for SQL."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [c.split(" ", 1) for c in re.split(r",\s*", schema)]

    def df(self, spark: SparkSession) -> DataFrame:
        plain = self.schema.replace("timestamp", "string")
        out = spark.createDataFrame(self.rows, plain)
        for c, t in self.columns:
            if t == "timestamp":
                out = out.withColumn(c, out[c].cast("timestamp"))
        return out

    @property
    def cte(self) -> str:
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        cast = ", ".join(f"CAST(c{i} AS {_type(t)}) AS {c}" for i, (c, t) in enumerate(self.columns))
        return f"{self.name} AS (SELECT {cast} FROM (VALUES {values}) AS t({', '.join(f'c{i}' for i in range(len(self.columns)))}))"


def ctes(*fixtures: Fixture) -> str:
    return "WITH " + ",\n".join(f.cte for f in fixtures)
