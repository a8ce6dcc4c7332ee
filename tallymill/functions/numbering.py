"""Row numbers over a whole table without one task that sees every row."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; only a local session may leave the setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Read back from a table, so that both uses see the same partitions."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """df with the 0-based place of each row in the order of the columns, which should tell all rows apart.

    Rows are dealt out by ranges of the order and numbered within each range; the ranges' sizes, one row
    each, give what comes before them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = dealt.withColumn("__inside", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__range", "__inside", "__before")


def dealt_by_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df read back from a table, with the `__range` of (keys, order) in which each row lies, for with_previous and with_latest."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))


def _stitched(dealt: DataFrame, keys: list[str], inside: Column, last: Column, carried: Column, name: str) -> DataFrame:
    """dealt with `name`: what is found inside a row's range, else what `carried` makes of the `last` of the key's earlier ranges, one row each."""
    ends = dealt.groupBy("__range", *keys).agg(last.alias("__last"))
    before = ends.select("__range", *keys, carried.alias("__carried")).alias("b")
    rows = dealt.withColumn("__inside", inside).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__range", *keys)]
    return rows.join(before, same).select(*(f"d.{c}" for c in dealt.columns), F.coalesce("__inside", "__carried").getField("x").alias(name))


def with_previous(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """With the value of the row before, in the order of the row's key; null for a key's first row. No task holds more than a range."""
    x = F.struct(F.col(value).alias("x"))
    here, own = Window.partitionBy("__range", *keys).orderBy(*order), Window.partitionBy(*keys).orderBy("__range")
    return _stitched(dealt, keys, F.lag(x).over(here), F.max_by(x, F.struct(*order)), F.lag("__last").over(own), name)


def with_latest(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """With the latest value that is not null, of the row itself or one before it in its key's order. No task holds more than a range."""
    known = F.col(value).isNotNull()
    x = F.when(known, F.struct(F.col(value).alias("x")))
    here = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return _stitched(dealt, keys, F.last(x, True).over(here), F.max_by(x, F.when(known, F.struct(*order))), F.last("__last", True).over(own), name)


def with_running_sum(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """With the sum of the values up to the row in its key's order (nulls count as 0). No task holds more than a range."""
    here = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__range", *keys).agg(F.sum(value).alias("__sum"))
    before = sums.select("__range", *keys, F.sum("__sum").over(own).alias("__before")).alias("b")
    rows = dealt.withColumn("__inside", F.sum(value).over(here)).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__range", *keys)]
    whole = F.coalesce("__before", F.lit(0)) + F.coalesce("__inside", F.lit(0))
    return rows.join(before, same).select(*(f"d.{c}" for c in dealt.columns), whole.alias(name))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: tuple[float, ...]) -> DataFrame:
    """(keys..., n, p): the exact percentiles of each group's values (nulls left out) by linear interpolation, without a task that holds a group.

    Equal values are counted first. Distinct ones are dealt out by ranges of (keys, value) and their counts summed up
    within a range; the sums of a group's ranges, one row each, give what comes before. A percentile is read off
    the two rows whose ranks lie around it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"key{k}" for k in range(len(keys))]
    values = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(keys, names)), F.col(value).alias("value"))
    counts = values.groupBy(*names, "value").agg(F.count(F.lit(1)).alias("times"))
    dealt = kept(counts.repartitionByRange(n, *names, "value").withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy(*names)
    sums = dealt.groupBy(*names, "range").agg(F.sum("times").alias("times"))
    before = sums.select(*names, "range", (F.sum("times").over(own.orderBy("range")) - F.col("times")).alias("before"), F.sum("times").over(own).alias("n"))
    here = Window.partitionBy("range", *names).orderBy("value")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["range", *names]]
    inside = dealt.withColumn("upto", F.sum("times").over(here)).alias("d").join(before.alias("b"), same)
    end = F.col("before") + F.col("upto")
    ranked = inside.select(*(F.col(f"d.{c}").alias(c) for c in names), "value", "n", (end - F.col("times")).alias("first"), end.alias("end"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("end")), F.col("value")))

    place = [F.lit(f) * (F.col("n") - 1) for f in fractions]
    found = ranked.groupBy(*names, "n").agg(*(at(r(x)).alias(f"{side}{k}") for k, x in enumerate(place) for side, r in (("low", F.floor), ("high", F.ceil))))
    mixed = lambda k, x: F.when(F.floor(x) == F.ceil(x), F.col(f"low{k}")).otherwise((F.ceil(x) - x) * F.col(f"low{k}") + (x - F.floor(x)) * F.col(f"high{k}")).cast("double")
    return found.select(*(F.col(k).alias(c) for c, k in zip(keys, names)), "n", F.array(*(mixed(k, x) for k, x in enumerate(place))).alias("p"))
