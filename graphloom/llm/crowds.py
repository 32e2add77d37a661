"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import cut

#: Rows of one key that meet that key's row of the other table in one task.
MOST = 500


def crowded(rows: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """``(key, blocks)`` of the keys of more than ``most`` rows: a row for at least ``most`` rows, so Spark broadcasts it only while it is small."""
    return cut(rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("blocks")).where("blocks > 1"))


def meet(rows: DataFrame, table: DataFrame, key: str, by: str, crowds: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, neither having a column ``block`` or ``blocks``.

    Rows of a key in ``crowds`` are dealt to its blocks by the hash of column
    ``by``, and each block gets a copy of the key's rows of ``table``; the
    result is that of the plain join.
    """
    crowds = crowds.withColumnRenamed(crowds.columns[0], key)
    dealt = rows.join(crowds, key, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(by), F.col("blocks")), F.lit(0).cast("long"))).drop("blocks")
    copies = table.join(crowds, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1).cast("long")) - 1))).drop("blocks")
    return dealt.join(copies, [key, "block"]).drop("block")
