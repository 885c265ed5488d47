"""Join of many rows with one row of facts a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in HOT of all rows is hot, so that there are fewer than HOT hot keys.
HOT = 64


def even_join(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows (read twice: let them be stored) with the facts' columns by key, nulls equal; n: the facts' column with the rows a key, left out of the result.

    Facts of hot keys, fewer than HOT by their definition, are broadcast; the other rows meet theirs by a shuffle in
    which no key has more than one row in HOT. Every key of rows must be among the facts.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    renamed = facts.withColumnRenamed(key, "__key")
    hot, cold = renamed.where(F.col(n) * HOT > total).drop(n), renamed.where(F.col(n) * HOT <= total).drop(n)
    same = F.col(key).eqNullSafe(F.col("__key"))
    seldom = rows.join(F.broadcast(hot.select("__key")), same, "left_anti").join(cold, same)
    return rows.join(F.broadcast(hot), same).drop("__key").unionByName(seldom.drop("__key"))
