"""Order-dependent folds over a key's time series: proximity de-duplication, runs, debounced transitions, skip scans.

Folds run over one key's sorted array inside the engine (aggregate over a sorted list). A key's series is one array, so a key has to
fit into a task; a longer series is cut into segments by time first (see cut_at_gaps), where cutting cannot change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def cut_at_gaps(rows: DataFrame, keys: list[str], at: str, gap: Column | float, to: str = "segment") -> DataFrame:
    """Numbers the stretches of a key that are more than `gap` apart: folds with that reach never look across such a cut."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return rows.withColumn(to, F.coalesce(F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def keep_strongest_nearby(rows: DataFrame, keys: list[str], at: str, strength: str, gap: float) -> DataFrame:
    """Within `gap` of the detection that is kept at the moment, keep the stronger one (strictly); the kept place moves with it."""
    pieces = cut_at_gaps(rows, keys, at, gap)
    item = F.struct(F.col(at).alias("f"), F.col(strength).alias("c"))
    kind = f"array<struct<f:{dict(rows.dtypes)[at]},c:{dict(rows.dtypes)[strength]}>>"
    near = lambda acc, x: (F.size(acc) > 0) & (x["f"] - F.element_at(acc, -1)["f"] <= gap)
    step = lambda acc, x: F.when(near(acc, x), F.when(x["c"] > F.element_at(acc, -1)["c"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = pieces.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(item)).alias("s")).select(*keys, F.explode(F.aggregate("s", F.expr(f"cast(array() as {kind})"), step)).alias("k"))
    return kept.select(*keys, F.col("k.f").alias(at), F.col("k.c").alias(strength))


def suppress_after(rows: DataFrame, keys: list[str], at: str, skip: float) -> DataFrame:
    """Skip scan: a hit hides all hits less than `skip` behind it; hidden hits hide nothing."""
    pieces = cut_at_gaps(rows, keys, at, skip)
    kind = f"array<{dict(rows.dtypes)[at]}>"
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) < skip), acc).otherwise(F.concat(acc, F.array(x)))
    return pieces.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(at)).alias("s")).select(*keys, F.explode(F.aggregate("s", F.expr(f"cast(array() as {kind})"), step)).alias(at))


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: number, length, first and last place of each. Null never equals anything, itself included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))).cast("int")
    marked = rows.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.count("*").alias("length"), F.first(value).alias(value), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))


def stable_at(rows: DataFrame, keys: list[str], order: list[str], value: str, need: int) -> DataFrame:
    """Per key the first row that is the `need`-th of a run of equal, non-null values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))).cast("int")
    marked = rows.withColumn("__run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = marked.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order))).where(F.col(value).isNotNull() & (F.col("__n") == need))
    return counted.groupBy(*keys).agg(F.min(F.struct(*order)).alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in order))


def debounced(rows: DataFrame, keys: list[str], at: str, hit: str, need: int, false_gap: float) -> DataFrame:
    """The first hit of the first candidate that `need` hits confirm; a stretch without hit longer than `false_gap` closes a candidate."""
    hits = cut_at_gaps(rows.where(F.col(hit)), keys, at, false_gap + 1, "__c")
    candidates = hits.groupBy(*keys, "__c").agg(F.count("*").alias("__n"), F.min(at).alias(at)).where(F.col("__n") >= need)
    return candidates.groupBy(*keys).agg(F.min(at).alias(at))


def timed_out(rows: DataFrame, keys: list[str], at: str, hit: str, quiet: float, end: Column | None = None) -> DataFrame:
    """Per stretch of hits, its last hit, where no hit follows for at least `quiet` (up to the series' end)."""
    closing = F.max(at).over(Window.partitionBy(*keys))
    hits = rows.withColumn("__end", end if end is not None else closing).where(F.col(hit))
    w = Window.partitionBy(*keys).orderBy(at)
    return hits.withColumn("__next", F.coalesce(F.lead(at).over(w), F.col("__end"))).where(F.col("__next") - F.col(at) >= quiet).select(*keys, at)


def changed_rows(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds changed: the value differs from the one before; a null on either side is no change."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("changed", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(False)))


def first_transition(rows: DataFrame, keys: list[str], order: str, most: int = 6) -> DataFrame:
    """Per key the index (from 0) of the first observation whose rows change: two totals, and a value of points or three rows at all.

    Of observations with fewer common rows as many as there are have to change; unknown values never do.
    rows: keys, order, points and totals (arrays by row), visible (number of rows).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    both = rows.select(*keys, F.row_number().over(w).alias("__i"), "points", "totals", "visible", *(F.lag(c).over(w).alias(f"__{c}") for c in ("points", "totals", "visible")))
    n = F.least(F.lit(most), F.coalesce("visible", F.lit(0)), F.coalesce("__visible", F.lit(0)))
    k = F.when(n > 0, n).otherwise(F.lit(min(most, 6)))
    changes = lambda c: F.transform(F.sequence(F.lit(1), k), lambda i: F.coalesce(F.try_element_at(c, i.cast("int")) != F.try_element_at(f"__{c}", i.cast("int")), F.lit(False)))
    true = lambda a: F.size(F.filter(a, lambda x: x))
    points, totals = changes("points"), changes("totals")
    some = true(F.zip_with(points, totals, lambda a, b: a | b))
    hit = (true(totals) >= F.least(F.lit(2), k)) & ((true(points) >= 1) | (some >= F.least(F.lit(3), k)))
    return both.where("__i > 1").where(hit).groupBy(*keys).agg(F.min(F.col("__i") - 1).cast("long").alias("index"))
