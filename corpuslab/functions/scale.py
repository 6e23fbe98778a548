"""Patterns for order-dependent work without a one-partition window, and seeded hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def hash_order(seed: int | str, *columns: str) -> Column:
    """A seeded order of rows that is the same in every engine with MD5: a hexadecimal digest."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_mod(text: Column, modulus: int) -> Column:
    """The first 16 hexadecimal digits of SHA-1, as a number, modulo ``modulus``."""
    return (F.conv(F.substring(F.sha1(text), 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def ranked(df: DataFrame, order: list[Column], total: dict[str, Column] | None = None, rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds the global rank from 1 (``order`` must be total) and inclusive running sums of ``total``.

    Rows are dealt by ranges of the order; per range only a count and sums, and their prefixes over ranges, whose
    number is that of partitions, are joined back. No row meets a window over all rows. The dealt rows are written
    once, so that both steps see the same ranges.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = total or {}
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranked")
    within = Window.partitionBy("__p").orderBy(*order)
    local = dealt.withColumn("__r", F.row_number().over(within))
    for name, value in total.items():
        local = local.withColumn(f"__s_{name}", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = dealt.groupBy("__p").agg(F.count("*").alias("__n"), *[F.sum(v).alias(f"__t_{k}") for k, v in total.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in total])
    out = local.join(F.broadcast(offsets), "__p").withColumn(rank, F.col("__r") + F.col("__before"))
    for name in total:
        out = out.withColumn(name, F.col(f"__s_{name}") + F.col(f"__b_{name}"))
    return out.drop("__p", "__r", "__before", *[f"__s_{k}" for k in total], *[f"__b_{k}" for k in total])


def hash_ranked(df: DataFrame, seed: int | str, keys: list[str], groups: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """Adds the global rank from 1 by ``groups``, then ``hash_order`` of ``keys``, which name each row.

    Hashes are even, so their first three digits deal the rows into 4,096 buckets per group: only counts of buckets are
    ranked over ranges, and rows are shuffled once, by bucket, and not written.
    """
    groups = groups or []
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]))
    bucket = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    own = df.withColumns({"__h": F.unhex(digest), "__k": bucket})
    counts = df.groupBy(*groups, bucket.alias("__k")).agg(F.count("*").alias("__n"))
    placed = ranked(counts, [*[F.col(g) for g in groups], F.col("__k")], {"__upto": F.col("__n")})
    offsets = placed.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__k").alias("__k2"), (F.col("__upto") - F.col("__n")).alias("__before"))
    same = F.col("__k") == F.col("__k2")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*groups, "__k").orderBy("__h")
    local = own.withColumn("__r", F.row_number().over(within)).join(offsets, same)
    return local.withColumn(rank, F.col("__r") + F.col("__before")).drop("__h", "__k", "__k2", "__r", "__before", *[f"__g{i}" for i in range(len(groups))])
