"""As-of joins that hold up under frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the time axis; a key has at most so many rows in the second step.
SLICES = 64


def latest_earlier(rows: DataFrame, keys: list[str], time: str, offered: Column, slices: int = SLICES) -> DataFrame:
    """rows with a column `found`: the non-null `offered` value of the key's latest row at an earlier time.

    Of several at that time the largest value counts. Rows with a null key or time find nothing.
    The time axis is cut at quantiles of all rows. A key's rows are looked through slice by slice,
    so that a key with a third of all rows is many tasks; what a slice inherits comes from the
    last offers of the slices before, one row per key and slice.
    """
    ends = rows.select(F.percentile_approx(time, [(k + 1) / slices for k in range(slices - 1)], 10_000).alias("e")).first()["e"] or []
    ends = sorted(set(ends))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col(time))) if ends else F.lit(0)
    known = F.col(time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # rows that find nothing are spread out
    rows = rows.withColumn("__part", F.when(known, part).otherwise(-1 - F.pmod(F.monotonically_increasing_id(), F.lit(4096))).cast("int"))
    rows = rows.withColumn("__offer", F.when(known & offered.isNotNull(), F.struct(F.col(time).alias("t"), offered.alias("v"))))
    last = rows.filter(known).groupBy(*keys, "__part").agg(F.max("__offer").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.max("__last").over(before).alias("__carried"))
    match = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)] + [F.col("__part") == F.col("__p")]
    here = Window.partitionBy(*keys, "__part").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.max("__offer").over(here)).join(last, match, "left")
    found = F.greatest("__own", "__carried")["v"]
    return rows.withColumn("found", found).drop("__offer", "__part", "__own", "__p", "__carried", *[f"__k{i}" for i in range(len(keys))])
