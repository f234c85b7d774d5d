"""Values of whole groups on each of their rows, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_group_values(rows: DataFrame, key: str, by: Column, parts: dict[str, Column], totals: dict[str, Column], where: str | None = None, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with values of their groups: ``parts`` are aggregates over a salted part of a group, ``totals`` over the parts' columns.

    A group's rows are dealt over ``salts`` parts by a hash of ``by``, both when they are aggregated and when they meet the values again; a small group has no more
    copies of its values than rows. ``where``, a condition on the totals, leaves other groups out. Null keys are left out.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    each = dealt.where(F.col(key).isNotNull()).groupBy(key, "_salt").agg(*(v.alias(n) for n, v in parts.items()))
    whole = each.groupBy(key).agg(*(v.alias(n) for n, v in totals.items()), F.collect_list("_salt").alias("_salts"))
    if where:
        whole = whole.where(where)
    return dealt.join(whole.select(key, *totals, F.explode("_salts").alias("_salt")), [key, "_salt"]).drop("_salt")


def with_few(rows: DataFrame, few: DataFrame, key: str, by: Column, salts: int = 64) -> DataFrame:
    """Inner join with a table that has one row for each of a few large groups: its rows are copied to every salt, so no group meets in one task."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")
