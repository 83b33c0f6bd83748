"""Finding, loading and changing rows of catalog tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNIQUE


class Null:
    """Matches rows whose attribute is null; the class or an instance will do."""


@dataclass(frozen=True)
class In:
    values: list | tuple

    def __post_init__(self):
        if isinstance(self.values, str):
            raise TypeError("In takes a list or tuple, not a string")


def condition(df: DataFrame, **query: Any) -> Column:
    where = F.lit(True)
    for name, value in query.items():
        if name not in df.columns:
            raise ValueError(f"no attribute {name}; there are {', '.join(df.columns)}")
        column = F.col(name)
        if value is Null or isinstance(value, Null):
            where &= column.isNull()
        elif isinstance(value, In):
            where &= column.isin(list(value.values)) if value.values else F.lit(False)
        else:
            where &= F.coalesce(column == F.lit(value), F.lit(False))
    return where


def find(df: DataFrame, *, sort: str | None = None, **query: Any) -> DataFrame:
    """Rows that match every attribute: a value, Null or In. sort: SQL order terms."""
    found = df.where(condition(df, **query))
    return found.orderBy(*[F.expr(t.rsplit(" ", 1)[0]).desc() if t.lower().endswith(" desc") else F.expr(t.removesuffix(" asc").removesuffix(" ASC")).asc() for t in map(str.strip, sort.split(","))]) if sort else found


def find_ids(df: DataFrame, **query: Any) -> DataFrame:
    return find(df, **query).select("id")


def load(df: DataFrame, id_: int):
    rows = df.where(F.col("id") == id_).take(2)
    if len(rows) != 1:
        raise LookupError(f"id {id_} has {len(rows)} rows, not one")
    return rows[0]


def referenced_at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys that at least n rows hold."""
    return df.groupBy(key).count().where(F.col("count") >= n).select(key)


def violations(df: DataFrame, table: str) -> DataFrame:
    """Key values that stand more than once although the table's key is unique."""
    return df.groupBy(*UNIQUE[table]).count().where("count > 1")


def get_or_insert(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known (id, key) with ids for the keys of new that it lacks, after the last id, in key order."""
    from .ranking import with_global_rank

    missing = new.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.select("id", key).unionByName(with_global_rank(missing, [F.col(key)], "_rank").select((F.col("_rank") + 1 + last).alias("id"), key))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """current with changes applied in the order of seq; the last change of a key wins, and deletes it if ``deleted``."""
    base = current.withColumn("_seq", F.lit(None).cast("long")).withColumn("deleted", F.lit(False))
    merged = base.unionByName(changes.withColumn("_seq", F.col(seq).cast("long")).select(*base.columns))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_seq").desc_nulls_last()))
    return merged.withColumn("_rn", newest).where("_rn = 1 and not deleted").drop("_rn", "_seq", "deleted")


def update_one(df: DataFrame, id_: int, **values: Any) -> DataFrame:
    load(df, id_)
    return df.select(*[F.when(F.col("id") == id_, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, **query: Any) -> DataFrame:
    return df.where(~condition(df, **query))
