"""Registration of queries and the edge conversion for engine-to-engine comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Same rows in types every SQL engine returns alike.

    Decimals become doubles, instants become naive UTC timestamps, and arrays become
    '|'-joined text. Only this edge converts; the operators keep their declared types.
    """
    out, zone = [], df.sparkSession.conf.get("spark.sql.session.timeZone")
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
            if zone != "UTC":  # zones are looked up by name for every row
                c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its counterpart."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add
