"""Buckets of candidates that stay small: hot ones are split without losing a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = 0x2545F491


def split_by_rare_tokens(members: DataFrame, keep: Column) -> DataFrame:
    """(key, id, sub): smaller buckets in place of the buckets of ``members`` (key, id, tokens).

    A member goes to the buckets of its ``keep`` rarest tokens, by how many
    members of its old bucket have them. Two sets whose common tokens are so
    many that not all can lie outside both prefixes share a bucket: with n
    tokens and o or more in common, ``keep`` is n - o + 1. So no such pair is
    lost, while members that have only what everyone there has don't meet.

    ``tokens`` are distinct bigints; sets of tokens nobody else has, empty sets
    and null ones give no row; an empty table gives none.
    """
    each = members.select("key", "id", keep.alias("keep"), F.explode("tokens").alias("token")).withColumn("sub", F.xxhash64("key", "token"))
    # The join's key isn't what the counts are partitioned by, so that a hot token's partition may be split.
    other = F.col("sub").bitwiseXOR(F.lit(_KEY).cast("bigint")).alias("k")
    seen = each.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).select(other, "n")
    # Either side is sized by the sets it was exploded from, so Spark would broadcast one many times the size it takes it for.
    met = each.select("key", "id", "keep", "sub", other).join(seen.hint("merge"), "k")
    least = F.slice(F.array_sort(F.collect_list(F.struct("n", "sub"))), F.lit(1), F.max("keep"))
    rare = met.groupBy("key", "id").agg(least.alias("rare"))
    return rare.select("key", "id", F.explode("rare").alias("t")).where("t.n > 1").select("key", "id", "t.sub")
