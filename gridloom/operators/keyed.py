"""Ordered keyed sets: set algebra, ranges, ranks and prefix aggregates over a DataFrame with a key.

The key is any list of columns; its order is the order of the set. Keys are distinct on
each side. Where both sides have a key the right one wins, or a combination of both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame, key: Sequence[str], combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    rest = [c for c in a.columns if c not in key]
    left, right = (d.select(*key, F.struct(*rest, F.lit(1).alias("_in")).alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    pick = combine or (lambda x, y: y)
    value = lambda c: F.when(F.col("_b").isNull(), F.col("_a")[c]).when(F.col("_a").isNull(), F.col("_b")[c]).otherwise(pick(F.col("_a")[c], F.col("_b")[c]))
    return left.join(right, list(key), "full").select(*key, *[value(c).alias(c) for c in rest])


def intersect(a: DataFrame, b: DataFrame, key: Sequence[str], combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    if combine is None:
        return b.join(a.select(*key), list(key), "left_semi")
    rest = [c for c in a.columns if c not in key]
    left, right = (d.select(*key, F.struct(*rest).alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    return left.join(right, list(key)).select(*key, *[combine(F.col("_a")[c], F.col("_b")[c]).alias(c) for c in rest])


def difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_anti")


def equal(a: DataFrame, b: DataFrame) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def upsert(a: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of batch replace those of their key; the others are added."""
    return difference(a, batch, key).unionByName(batch)


def insert_combine(a: DataFrame, batch: DataFrame, key: Sequence[str], **how: Callable[[str], Column]) -> DataFrame:
    """All rows of a key, in the set or the batch, become one; how: an aggregate for each other column."""
    return a.unionByName(batch).groupBy(*key).agg(*[f(c).alias(c) for c, f in how.items()])


def insert_reduce(a: DataFrame, batch: DataFrame, key: Sequence[str], **how: Callable[[str], Column]) -> DataFrame:
    """Rows of a key within the batch become one, which then replaces that of the set."""
    return upsert(a, batch.groupBy(*key).agg(*[f(c).alias(c) for c, f in how.items()]), key)


def update_found(a: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of batch replace those of their key; keys not in the set are left out."""
    return upsert(a, intersect(a, batch, key), key)


def find(a: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every row of keys with the set's columns, null where the key is absent."""
    return keys.select(*key).join(a, list(key), "left")


def _tuple(key: Sequence[str], values: Sequence) -> tuple[Column, Column]:
    return F.struct(*key), F.struct(*[F.lit(v).alias(k) for k, v in zip(key, values, strict=True)])


def before(key: Sequence[str], values: Sequence) -> Column:
    """key < values, as comparisons of columns that reach the scan."""
    out, same = F.lit(False), F.lit(True)
    for k, v in zip(key, values, strict=True):
        out = out | (same & (F.col(k) < F.lit(v)))
        same = same & (F.col(k) == F.lit(v))
    return out


def at(key: Sequence[str], values: Sequence) -> Column:
    out = F.lit(True)
    for k, v in zip(key, values, strict=True):
        out = out & (F.col(k) == F.lit(v))
    return out


def key_range(a: DataFrame, key: Sequence[str], lo: Sequence, hi: Sequence) -> DataFrame:
    """lo <= key <= hi."""
    return a.where(~before(key, lo) & (before(key, hi) | at(key, hi)))


def rank(a: DataFrame, key: Sequence[str], values: Sequence) -> DataFrame:
    """How many keys are smaller."""
    return a.where(before(key, values)).agg(F.count(F.lit(1)).alias("n"))


def ranked(a: DataFrame, key: Sequence[str], name: str = "rank") -> DataFrame:
    """Each row's 0-based place, by range partitions and a running sum of their sizes: no task holds all rows."""
    spark = a.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = a.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    part = part.persist()
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return part.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_n", "_start")


def select(a: DataFrame, key: Sequence[str], place: int) -> DataFrame:
    """The entry at a 0-based rank."""
    return a.orderBy(*key).offset(place).limit(1)


def take(a: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    return a.orderBy(*key).limit(k)


def between_ranks(a: DataFrame, key: Sequence[str], start: int, end: int) -> DataFrame:
    """Entries of rank start <= r < end."""
    return a.orderBy(*key).offset(start).limit(max(0, end - start))


def reverse(a: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.orderBy(*[F.col(k).desc() for k in key])


def first_unsorted(a: DataFrame, index: str, value: str) -> DataFrame:
    """The smallest index whose value is below its predecessor's; null if sorted.

    Only neighbours are compared, by a join on the index, so order needs no single task."""
    prev = a.select((F.col(index) + 1).alias(index), F.col(value).alias("_prev"))
    return a.join(prev, index).where(F.col(value) < F.col("_prev")).agg(F.min(index).alias("at"))


def map_values(a: DataFrame, **made: Column) -> DataFrame:
    return a.withColumns(made)


def map_reduce(a: DataFrame, **how: Column) -> DataFrame:
    return a.agg(*[e.alias(c) for c, e in how.items()])


def aggregate_range(a: DataFrame, key: Sequence[str], lo: Sequence | None, hi: Sequence | None, **how: Column) -> DataFrame:
    """Aggregates over keys from lo to hi, both included; None leaves a side open."""
    if lo is not None:
        a = a.where(~before(key, lo))
    if hi is not None:
        a = a.where(before(key, hi) | at(key, hi))
    return map_reduce(a, **how)


def aggregate_select(a: DataFrame, key: Sequence[str], value: str, limit) -> DataFrame:
    """The first entry at which the running sum of value exceeds limit, with `running`.

    Sums of range partitions are added first; only the partition that crosses is looked into row by row."""
    spark = a.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = a.repartitionByRange(n, *key).withColumn("_part", F.spark_partition_id()).persist()
    sums = part.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    run = F.col("_start") + F.sum(value).over(W.partitionBy("_part").orderBy(*key).rowsBetween(W.unboundedPreceding, 0))
    out = part.join(starts, "_part").withColumn("running", run).where(F.col("running") > limit)
    return out.drop("_part", "_sum", "_start").orderBy(*key).limit(1)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def aggregate_filter(a: DataFrame, keep: Column) -> DataFrame:
    """Entries whose own aggregate satisfies a condition."""
    return a.where(keep)


def take_while(a: DataFrame, key: Sequence[str], go_on: Column) -> DataFrame:
    """Entries in the order of the key that come before the first one for which go_on does not hold."""
    stop = a.where(~F.coalesce(go_on, F.lit(False))).agg(F.min(F.struct(*key)).alias("_stop"))
    return a.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.struct(*key) < F.col("_stop"))).drop("_stop")  # one row


def from_sorted(a: DataFrame, key: Sequence[str]) -> DataFrame:
    """A set from rows in order, of which the last of each key counts. Rows are dealt by key, so their order needs no sort."""
    rest = [c for c in a.columns if c not in key]
    last = a.withColumn("_at", F.monotonically_increasing_id()).groupBy(*key).agg(F.max_by(F.struct(*rest), "_at").alias("_r"))
    return last.select(*key, "_r.*")


def insert_one(a: DataFrame, **row) -> DataFrame:
    """The set with one row put in, or in place of that of its key (the first column)."""
    one = a.sparkSession.createDataFrame([tuple(row[c] for c in a.columns)], a.schema)
    return upsert(a, one, [a.columns[0]])


def remove_one(a: DataFrame, key: Sequence[str], values: Sequence) -> DataFrame:
    return a.where(~at(key, values))
