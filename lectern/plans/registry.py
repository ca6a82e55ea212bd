"""Named queries, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, IntegerType, ShortType

from lectern.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain_types(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, so both engines name the same types."""
    casts = {ByteType: "long", ShortType: "long", IntegerType: "long", FloatType: "double"}
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name) if type(f.dataType) in casts
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain_types(build(Tables(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add
