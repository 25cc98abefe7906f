"""Registry of the engine's queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that gives its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


_KINDS = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<long>": "BIGINT[]"}


class Fixture:
    """A small table that exists in both engines."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.strip().split(" ") for c in schema.split(",")]

    def frame(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        casts = ", ".join(f"CAST({n} AS {_KINDS[k]}) AS {n}" for n, k in self.columns)
        names = ", ".join(n for n, _ in self.columns)
        return f"(SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)}) AS v({names}))"


class Derived(Fixture):
    """The rows of a fixture and, for each row of a given table, one whose
    columns are expressions that both engines read. Ids of the fixture stay
    under 1,000."""

    _CASTS = {"string": "STRING", "long": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def __init__(self, schema: str, rows: list[tuple], source: str, *expressions: str):
        super().__init__(schema, rows)
        self.source = source
        self.each = [f"CAST({e} AS {self._CASTS[k]}) AS {n}" for e, (n, k) in zip(expressions, self.columns, strict=True)]

    def frame(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        return super().frame(spark).unionByName(spark.read.parquet(f"{sf}/{self.source}.parquet").selectExpr(*self.each))

    @property
    def sql(self) -> str:
        return f"(SELECT * FROM {super().sql} UNION ALL SELECT {', '.join(self.each)} FROM {self.source})"
