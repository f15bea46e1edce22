"""Prefix sums over a total order without a single task: range partitions, their sums, then a running sum inside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def prefix_sums(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Adds upto (the sum of `value` up to the row by `order`, which has to be unique) and total.

    The rows are cut into value ranges of `order` by approximate quantiles; one sum per range (at most 1,000 of them) is summed up
    in one task and goes by the driver, and the rows' own running sums are made range by range. The sums come back as constants: a
    join on a range number that is computed from `order` can make the optimizer put that expression on the side that has no `order`.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / 1000 for i in range(1, 1000)], 10_000).alias("q")).first()["q"] or []
    parts = rows.withColumn("__p", F.size(F.filter(F.lit(sorted(set(cuts))), lambda x: x < F.col(order))) if cuts else F.lit(0))
    sums = parts.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"), F.sum("__s").over(Window.partitionBy()).alias("total"))
    known = before.collect()
    at = {r["__p"]: r["__b"] for r in known}
    kind = dict(before.dtypes)
    ahead = F.lit([at.get(p, 0) for p in range(len(cuts) + 1)]).cast(f"array<{kind['__b']}>")
    own = Window.partitionBy("__p").orderBy(order)
    summed = parts.withColumn("__own", F.sum(value).over(own)).withColumn("total", F.lit(known[0]["total"] if known else None).cast(kind["total"]))
    return summed.withColumn("upto", F.col("__own") + F.get(ahead, F.col("__p"))).drop("__p", "__own")
