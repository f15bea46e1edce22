"""Weighted votes and counts over repeated observations."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F


def weighted_vote(rows: DataFrame, keys: list[str], value: str, weight: Column, ordinal: str, source: str | None = None) -> DataFrame:
    """Per key the value with the largest weight sum and its share; the first seen wins a tie. Nulls and "" cast no vote.

    With `source`, the heaviest source label within the winning value too (blank: "default").
    """
    cast = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).withColumn("__w", F.greatest(weight, F.lit(0.0)))
    sums = cast.groupBy(*keys, value).agg(F.sum("__w").alias("__s"), F.min(ordinal).alias("__o"))
    best = sums.groupBy(*keys).agg(F.max_by(value, F.struct("__s", -F.col("__o"))).alias(value), F.max("__s").alias("__b"), F.sum("__s").alias("__t"))
    out = best.select(*keys, value, F.when(F.col("__t") > 0, F.col("__b") / F.col("__t")).otherwise(0.0).alias("confidence"))
    if source:
        label = F.when(F.trim(F.coalesce(F.col(source).cast("string"), F.lit(""))) == "", F.lit("default")).otherwise(F.col(source).cast("string"))
        from_ = cast.groupBy(*keys, value, label.alias("source")).agg(F.sum("__w").alias("__s"), F.min(ordinal).alias("__o"))
        top = from_.groupBy(*keys, value).agg(F.max_by("source", F.struct("__s", -F.col("__o"))).alias("source"))
        out = out.join(top, [*keys, value])
    return out


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where no weight is left."""
    w = F.greatest(weight, F.lit(0.0))
    return F.when(F.sum(w) > 0, F.sum(value * w) / F.sum(w))


def smallest_mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key, the smallest of equals."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def plurality(rows: DataFrame, keys: list[str], value: str, prefer: Column) -> DataFrame:
    """The most frequent value; of equals the preferred one, else the smallest."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.max(prefer.cast("int")).alias("__p"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), -F.col("__p"), F.col(value))).alias(value))


def histogram_text(rows: DataFrame, keys: list[str], value: str, unit: str) -> DataFrame:
    """"v unit x n" of every value, largest value first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    line = F.concat(F.col(value).cast("string"), F.lit(f" {unit} x "), F.col("__n").cast("string"))
    pair = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), line.alias("t"))), asc=False)
    return counts.groupBy(*keys).agg(F.concat_ws(", ", F.transform(pair, lambda p: p["t"])).alias("histogram"))


def percentile_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, least, p50, p90, p95, p99, largest and mean, with linear interpolation."""
    q = F.percentile(value, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), q.alias("q"), F.max(value).alias("largest"), F.avg(value).alias("mean"))
    return out.select(*keys, "n", "least", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))), "largest", "mean")


def point_override(rows: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """Take the points that the totals imply (new - old, 1 to 15) where they have at least as many votes as the current ones.

    rows: keys, points, old_total, new_total; votes: keys, points, votes.
    """
    implied = F.col("new_total") - F.col("old_total")
    base = rows.withColumn("implied", F.when(implied.between(1, 15), implied))
    of = lambda c, to: votes.select(*keys, F.col("points").alias(c), F.col("votes").alias(to))
    both = base.join(of("points", "__now"), [*keys, "points"], "left").join(of("implied", "__new"), [*keys, "implied"], "left")
    take = F.col("implied").isNotNull() & (F.coalesce("__new", F.lit(0)) >= F.greatest(F.lit(1), F.coalesce("__now", F.lit(0))))
    return both.withColumn("resolved", F.when(take, F.col("implied")).otherwise(F.col("points"))).drop("__now", "__new")


def dominant_variant(rows: DataFrame, keys: list[str], value: str, margin: str, least: int = 3, share: float = 0.9, mean_margin: float = 0.5) -> DataFrame:
    """Give a whole group its winner where it has `least` rows, the winner's share and the mean margin are high enough."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.sum(margin).alias("__m"))
    best = counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias("__v"), F.max("__n").alias("__b"), F.sum("__n").alias("__t"), F.sum("__m").alias("__s"))
    ok = (F.col("__t") >= least) & (F.col("__b") >= share * F.col("__t")) & (F.col("__s") >= mean_margin * F.col("__t"))
    return best.select(*keys, F.when(ok, F.col("__v")).alias("winner"), F.col("__t").alias("n"))


def top_k(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per key, the earlier by `tie` among equals; the engine keeps k per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def weight_grid(rows: DataFrame, keys: list[str], candidate: str, features: list[str], steps: int = 20) -> DataFrame:
    """Per vector of weights (multiples of 1/steps with the sum 1) the groups whose lowest candidate has the highest weighted sum.

    Features are whole numbers, candidates whole numbers from 0 below 2**20; of equal sums the lower candidate wins. All vectors are
    summed up in one pass: a group gives one number per vector, and nothing is multiplied by the grid.
    """
    grid = [v for v in itertools.product(range(steps + 1), repeat=len(features)) if sum(v) == steps]
    shift = F.lit(1 << 20)
    score = lambda v: sum((F.lit(w) * F.col(f) for w, f in zip(v, features)), F.lit(0).cast("long"))
    best = rows.groupBy(*keys).agg(F.min(candidate).alias("__t"), *[F.max(score(v) * shift + (shift - 1 - F.col(candidate))).alias(f"__{n}") for n, v in enumerate(grid)])
    right = best.agg(*[F.count_if(shift - 1 - F.pmod(F.col(f"__{n}"), shift) == F.col("__t")).alias(f"__{n}") for n in range(len(grid))])
    cells = [F.struct(*[F.lit(w / steps).alias(f) for w, f in zip(v, features)], F.col(f"__{n}").alias("correct")) for n, v in enumerate(grid)]
    return right.select(F.inline(F.array(*cells)))
