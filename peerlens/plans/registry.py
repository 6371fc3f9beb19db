"""Named queries over the given tables, each with its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def tidy(df: DataFrame, *cols: str, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Chosen columns with doubles rounded and whole numbers widened, for comparison across engines."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for c in cols or df.columns:
        if types[c] in ("double", "float") and c not in exact:
            out.append(F.round(F.col(c).cast("double"), digits).alias(c))
        elif types[c] in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def r6(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c},{digits}) AS {c}" for c in cols)


def big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)
