"""Ranks, running sums and exact quantiles over whole tables, without a window over all rows.

Rows fall into order-preserving buckets; one small aggregate gives what lies before each
bucket, and only rows of one bucket meet in a task.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at least and at most, and the estimated bytes that one should hold.
FEWEST, MOST, HELD = 512, 4096, 64 << 20
#: Estimated bytes up to which a table is one bucket.
SMALL = 16 << 20
#: A value in this many buckets or more is cut by ident, into TIE_PARTS parts.
TIED, TIE_PARTS = 16, 64


def _before(counts: DataFrame, keys: list[str], bucket: str, sums: list[str]) -> DataFrame:
    """What lies before each bucket: the aggregate has a few thousand rows a key, more only where ties are cut."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, bucket, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{s}_before") for s in sums])


def ranked_by_hex(df: DataFrame, hexed: str, rank: str = "rank", digits: int = 3) -> DataFrame:
    """Adds the 0-based rank by a column of hex digests, which spread evenly over their prefixes."""
    df = df.withColumn("_bucket", F.substring(hexed, 1, digits))
    before = _before(df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), [], "_bucket", ["_n"])
    w = Window.partitionBy("_bucket").orderBy(hexed)
    return df.join(F.broadcast(before), "_bucket").withColumn(rank, F.col("_n_before") + F.row_number().over(w) - 1).drop("_bucket", "_n_before")


def bucket_count(df: DataFrame) -> int:
    """Buckets for a table, by the planner's estimate of its bytes; one for a table that a task sorts at once, which saves the scan for the bounds."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 if size <= SMALL else max(FEWEST, min(MOST, size // HELD))


def _levels(df: DataFrame, value: str, parts: int) -> list[float]:
    """The parts - 1 inner quantiles of a double column, approximate, ascending and with repeats; non-finite ones are left out."""
    held = df.approxQuantile(value, [k / parts for k in range(1, parts)], 0.5 / parts)
    return [v + 0.0 for v in held if math.isfinite(v)]


def _search(df: DataFrame, value: str, levels: list[float], out: str) -> DataFrame:
    """Adds the bucket of a double column between the levels: nulls in -1, NaN in the last; a repeated level has a bucket of its own."""
    splits = {-math.inf, math.inf, *levels, *[math.nextafter(v, math.inf) for v, n in Counter(levels).items() if n > 1]}
    if len(splits) < 3:
        splits |= {0.0}
    df = Bucketizer(splits=sorted(splits), inputCol=value, outputCol=out, handleInvalid="keep").transform(df)
    return df.withColumn(out, F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.col(out).cast("int")))


def bucketed(df: DataFrame, value: Column, buckets: int | None = None, ident: str | None = None) -> DataFrame:
    """Adds an order-preserving _bucket, -1 and up, with about as many rows in each whatever the values' spread.

    The bounds are approximate quantiles, so outliers and skew don't fill one bucket.  A value
    that fills TIED buckets or more is cut by the quantiles of a numeric ident among its rows.
    """
    buckets = buckets or bucket_count(df)
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0))
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))
    df = df.withColumn("_double", plain)
    levels = _levels(df, "_double", buckets)
    df = _search(df, "_double", levels, "_bucket")
    tied = [v for v, n in Counter(levels).items() if n >= TIED]
    kind = dict(df.dtypes).get(ident, "")
    if tied and kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        df = df.withColumn("_ident", F.when(F.col("_double").isin(tied), F.col(ident).cast("double")))
        df = _search(df, "_ident", _levels(df, "_ident", TIE_PARTS), "_part")
        df = df.withColumn("_bucket", F.col("_bucket") * (2 * TIE_PARTS + 2) + F.col("_part") + 1).drop("_ident", "_part")
    return df.drop("_double")


def running(df: DataFrame, order: Column, ident: str, sums: dict[str, Column], keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Adds running sums, this row included, in the order of (order, ident) within the keys.

    order: numeric; nulls come first, NaN last.  Keys times a few thousand rows at most are aggregated; a hot
    key is cut into its buckets.
    """
    keys = keys or []
    buckets = buckets or bucket_count(df)
    df = df.withColumns({"_order": order, **{f"_v_{k}": c for k, c in sums.items()}})
    if buckets == 1:
        w = Window.partitionBy(*keys).orderBy("_order", ident).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(f"_v_{k}").over(w) for k in sums}).drop("_order", *[f"_v_{k}" for k in sums])
    df = bucketed(df, F.col("_order"), buckets, ident)
    totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{k}").alias(k) for k in sums])
    before = _before(totals, keys, "_bucket", list(sums))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_order", ident).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(before, [*keys, "_bucket"])
    out = out.withColumns({k: F.col(f"{k}_before") + F.sum(f"_v_{k}").over(w) for k in sums})
    return out.drop("_order", "_bucket", *[f"_v_{k}" for k in sums], *[f"{k}_before" for k in sums])


def ranked(df: DataFrame, order: Column, ident: str, rank: str = "rank", keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Adds the 0-based rank by (order, ident) within the keys."""
    return running(df, order, ident, {rank: F.lit(1)}, keys, buckets).withColumn(rank, F.col(rank) - 1)


def quantiles(df: DataFrame, value: Column, levels: list[float], keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: (keys, level, q).

    Counts of distinct values in the buckets that hold the two neighbours of each level are
    all that is looked at closely.
    """
    keys = keys or []
    df = df.select(*keys, value.alias("_x")).where(F.col("_x").isNotNull())
    df = bucketed(df, F.col("_x"), buckets)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    placed = counts.select(*keys, "_bucket", "_n", (F.sum("_n").over(w) - F.col("_n")).alias("_from"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    asked = placed.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).withColumn("_at", F.col("level") * (F.col("_all") - 1))
    asked = asked.select(*keys, "_bucket", "_from", "level", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank")).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    values = df.join(asked.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi").groupBy(*keys, "_bucket", "_x").agg(F.count(F.lit(1)).alias("_m"))
    v = Window.partitionBy(*keys, "_bucket").orderBy("_x")
    values = values.withColumn("_upto", F.sum("_m").over(v))
    hit = asked.join(values, [*keys, "_bucket"]).where((F.col("_rank") - F.col("_from") < F.col("_upto")) & (F.col("_rank") - F.col("_from") >= F.col("_upto") - F.col("_m")))
    low, high = F.min_by("_x", "_rank"), F.max_by("_x", "_rank")
    return hit.groupBy(*keys, "level").agg((low + (F.first("_at") - F.floor(F.first("_at"))) * (high - low)).alias("q"))
