"""All pairs of the members of groups, where a result must list them: hot groups are cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Members of a block: a task of the join makes at most the pairs of two blocks.
BLOCK = 2_000


def _blocked(members: DataFrame, keys: list[str], sizes: DataFrame, id_: str) -> DataFrame:
    """Members with the number of blocks of their group and their own block."""
    return members.join(sizes, keys).withColumn("_b", F.pmod(F.xxhash64(id_), F.col("_s")))


def paired(members: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """``members``: keys and an id, distinct. keys, x, y of every two different ids of a group, once, with x < y.

    A group of n members is cut into n / BLOCK blocks, and each pair of blocks is a join key of its own; a
    member is copied once a block, which is a small part of the pairs it has.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.ceil(F.col("_n") / BLOCK).cast("bigint").alias("_s"))
    rows = _blocked(members, keys, sizes, id_)
    # blocks (i, j) with i <= j; a block meets itself once
    left = rows.select(*keys, F.col(id_).alias("x"), F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_s") - 1)).alias("_j"))
    right = rows.select(*keys, F.col(id_).alias("y"), F.col("_b").alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b"))).alias("_i"))
    pairs = left.join(right, [*keys, "_i", "_j"]).where((F.col("_i") < F.col("_j")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return pairs.select(*keys, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def crossed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` joined with ``right`` on keys; the side of a hot key is cut into blocks by rows and the other copied to them.

    Both keep all their columns, which must differ but for the keys.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias(name))
    sizes = size(left, "_sl").join(size(right, "_sr"), keys)
    at = lambda df, own: df.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col("_sl" if own == "_i" else "_sr")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    a = at(left, "_i").withColumn("_j", upto("_sr")).drop("_sl", "_sr")
    b = at(right, "_j").withColumn("_i", upto("_sl")).drop("_sl", "_sr")
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")
