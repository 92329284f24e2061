"""Consecutive numbers for distributed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.workspace import written


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1, part: str | None = None) -> DataFrame:
    """df with consecutive numbers from `start` in the order of `order` (which must tell rows apart for the numbers to be reproducible).

    Rows are dealt by range; each range is numbered by itself and shifted by the sizes before it, so no task sorts all rows; the ranges are a written table, so that they are the same if an executor is lost. With `part`, the number of the range stays as a column of that name.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = sorted(ranged.groupBy("__part").agg(F.count(F.lit(1))).collect())
    shifts, total = [], start - 1
    for at, n in sizes:
        shifts.append((at, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(shifts or [(0, start - 1)], "__part int, __shift long"))
    row = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ranged.withColumn("__row", row).join(offsets, "__part").withColumn(name, F.col("__shift") + F.col("__row")).drop("__row", "__shift")
    return out.withColumnRenamed("__part", part) if part else out.drop("__part")


def in_order(df: DataFrame, name: str) -> DataFrame:
    """df with consecutive numbers from 0 in the order in which it is read: rows before a partition's are counted first, and no row is moved."""
    part, line = F.spark_partition_id(), F.monotonically_increasing_id()
    sizes = sorted(df.select(part.alias("p")).groupBy("p").agg(F.count(F.lit(1))).collect())  # a row for each partition
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    shifts = F.lit(None).cast("long")
    if before:
        shifts = F.element_at(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1)]), part + 1)
    return df.withColumn(name, shifts + line.bitwiseAND(F.lit((1 << 33) - 1)))


def running(df: DataFrame, value: str, out: str, *, rank: str, part: str, largest: bool) -> DataFrame:
    """df with a running extreme of `value` along `rank`: the largest up to a row, or the smallest from a row on.

    Each range runs by itself, and one number for each range before (or after) it is added: rows of df come from numbered() with `part`.
    """
    f = F.max if largest else F.min
    ends = {r[0]: r[1] for r in df.groupBy(part).agg(f(value)).collect()}
    seen, carry = None, []
    for p in sorted(ends, reverse=not largest):
        carry.append((p, seen))
        seen = ends[p] if seen is None else max(seen, ends[p]) if largest else min(seen, ends[p])
    beyond = F.broadcast(df.sparkSession.createDataFrame(carry or [(0, None)], f"`{part}` int, __beyond double"))
    w = Window.partitionBy(part).orderBy(F.asc(rank) if largest else F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)
    best = (F.greatest if largest else F.least)(f(value).over(w), F.col("__beyond"))
    return df.join(beyond, part).withColumn(out, best).drop("__beyond")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, value, name: the average rank of each distinct value among the rows of its keys.

    Counts of values are sorted by range over all tasks, and sums cross ranges by a number for each key and range, so that no task holds a key's rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()), "ranged")
    before, total = [], {}
    for *key, part, n in sorted(ranged.groupBy(*keys, "__part").agg(F.sum("__c")).collect(), key=lambda r: (r["__part"], *map(str, r))):
        before.append((*key, part, total.get(tuple(key), 0)))
        total[tuple(key)] = total.get(tuple(key), 0) + n
    schema = ", ".join([*(f"`{k}` {t}" for k, t in ranged.dtypes if k in keys), "__part int", "__before long"])
    if not before:
        return counts.select(*keys, value, F.lit(None).cast("double").alias(name))
    run = F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy(value)) - F.col("__c")
    ranks = ranged.withColumn("__less", run).join(F.broadcast(df.sparkSession.createDataFrame(before, schema)), [*keys, "__part"])
    return ranks.select(*keys, value, (F.col("__before") + F.col("__less") + (F.col("__c") + 1) / 2).alias(name))
