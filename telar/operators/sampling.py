"""Seeded sampling and allocation: pure functions of the seed and the row, alike in every partition and every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window


def hashed(seed: str, *cols: Column) -> Column:
    """An integer of 32 bits hashed from the seed and the values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 8), 16, 10).cast("long")


def clean_weight(w: Column) -> Column:
    """Positive finite weights; anything else counts 0."""
    return F.when(w.isNotNull() & ~F.isnan(w.cast("double")) & (w > 0) & (w.cast("double") < float("inf")), w).otherwise(F.lit(0))


def allocate(df: DataFrame, weight: str, total: int, order: str) -> DataFrame:
    """df with n: `total` shared out by weight, at least 1 for each positive weight where the total suffices.

    All weights zero count alike. What is left after flooring goes to the largest fractions, in order where these tie; where the
    total is below the number of positive weights, the first in order have 1. Weights are integers or doubles. One global window: the
    table is a dimension, of templates or the like.
    """
    one = Window.partitionBy(F.lit(0))
    w = df.withColumn("_w", clean_weight(F.col(weight)))
    w = w.withColumn("_w", F.when(F.sum("_w").over(one) == 0, 1).otherwise(F.col("_w")))
    positive = F.col("_w") > 0
    w = w.withColumn("_k", F.sum(positive.cast("long")).over(one)).withColumn("_s", F.sum("_w").over(one))
    w = w.withColumn("_place", F.row_number().over(one.orderBy(F.when(positive, 0).otherwise(1), order)))
    share = F.col("_w") * (F.lit(total) - F.col("_k")) / F.col("_s")
    w = w.withColumn("_share", F.when(positive, share).otherwise(0.0)).withColumn("_base", F.floor("_share"))
    w = w.withColumn("_rest", F.lit(total) - F.col("_k") - F.sum("_base").over(one))
    w = w.withColumn("_turn", F.row_number().over(one.orderBy(F.when(positive, 0).otherwise(1), F.desc(F.col("_share") - F.col("_base")), order)))
    n = F.when(F.lit(total) <= F.col("_k"), (positive & (F.col("_place") <= total)).cast("long")).otherwise(
        F.when(positive, 1 + F.col("_base") + (F.col("_turn") <= F.col("_rest")).cast("long")).otherwise(0))
    return w.withColumn("n", n.cast("long")).drop("_w", "_k", "_s", "_place", "_share", "_base", "_rest", "_turn")


def weighted_pick(draws: DataFrame, pool: DataFrame, weight: str, key: str, seed: str) -> DataFrame:
    """Each draw with one row of the pool (its key), picked by weight: the inverse of the cumulative weights at a hashed number.

    `draws` has draw. Integer weights are added up exactly, others as doubles. The pool is a dimension; its cumulative weights are
    ranges that the numbers fall into, found by an equi-join of as many equal steps as the pool has rows. All weights zero count alike.
    """
    exact = pool.schema[weight].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    one = Window.partitionBy(F.lit(0))
    w = pool.select(key, clean_weight(F.col(weight)).cast("long" if exact else "double").alias("_w"))
    w = w.withColumn("_w", F.when(F.sum("_w").over(one) == 0, 1).otherwise(F.col("_w"))).filter("_w > 0")
    w = w.withColumn("_high", F.sum("_w").over(one.orderBy(key))).withColumn("_low", F.lag("_high", 1, 0).over(one.orderBy(key)))
    sums = w.agg(F.max("_high").alias("_total"), F.count("*").alias("_m"))

    def step(c: str) -> Column:
        return F.least(F.floor(F.col(c).cast("double") / F.col("_total") * F.col("_m")), F.col("_m") - 1)

    # one row, that both sides may have
    ranges = w.crossJoin(F.broadcast(sums)).withColumn("_step", F.explode(F.sequence(step("_low"), step("_high")))).drop("_total", "_m")
    text = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string")))
    if exact:
        wide = F.conv(F.substring(text, 1, 15), 16, 10).cast("long")
        number = F.when(F.col("_total") < 1 << 32, hashed(seed, F.col("draw"))).otherwise(wide) % F.col("_total")
    else:
        number = F.conv(F.substring(text, 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("_total")
    at = draws.crossJoin(F.broadcast(sums)).withColumn("_at", number).withColumn("_step", step("_at"))
    return at.join(ranges, "_step").filter("_at >= _low and _at < _high").select("draw", key)


def uniform_pick(df: DataFrame, groups: list[str], key: str, seed: str) -> DataFrame:
    """One row's key of each group, the one with the smallest hash: an aggregate, no sort."""
    return df.groupBy(*groups).agg(F.min_by(key, F.struct(hashed(seed, F.col(key)), F.col(key))).alias(key))


def round_robin(df: DataFrame, order: str, values: list[str], name: str) -> DataFrame:
    """Values in turn, by the rows' place in order."""
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1, F.lit(len(values))) + 1).cast("int")))


def split(df: DataFrame, group: str, key: list[str], seed: str, share: float = 0.9) -> DataFrame:
    """df with side: by group, the first floor(share * n) distinct keys in hashed order are train, the others val.

    All rows of a key are on one side. Keys with a null count in n, come last, and their rows are left out, as are those without a group.
    Nothing is ranked but the keys of one of 65,536 ranges of the hash in each group, that in which train ends: distinct keys (texts by
    their SHA-256) are counted by range, and the last key of train is sent to all, one row a group.
    """
    h, last = hashed(seed, *map(F.col, key)), F.struct("_h", *key)
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rows = df.filter(F.col(group).isNotNull()).withColumn("_h", F.when(whole, h)).withColumn("_range", F.shiftright("_h", 16))
    short = [F.unhex(F.sha2(F.col(k), 256)).alias(f"_{i}") if df.schema[k].dataType == StringType() else F.col(k).alias(f"_{i}") for i, k in enumerate(key)]
    counts = rows.select(group, "_range", *short).distinct().groupBy(group, "_range").agg(F.count("*").alias("_c"))
    by = Window.partitionBy(group)
    end = F.least(F.floor(F.sum("_c").over(by) * share), F.coalesce(F.sum(F.when(F.col("_range").isNotNull(), F.col("_c"))).over(by), F.lit(0)))
    ends = counts.withColumn("_end", end).withColumn("_sum", F.sum("_c").over(by.orderBy(F.asc_nulls_last("_range"))))
    ends = ends.filter("_range is not null and _sum >= _end and _sum - _c < _end").select(group, "_range", (F.col("_end") - F.col("_sum") + F.col("_c")).alias("_place"))
    near = rows.join(F.broadcast(ends), [group, "_range"]).select(group, "_place", "_h", *key).distinct()
    cut = near.withColumn("_r", F.row_number().over(by.orderBy("_h", *key))).filter("_r = _place").select(group, last.alias("_last"))
    out = rows.filter(whole).join(F.broadcast(cut), group, "left")
    side = F.when((F.col("_h") < F.col("_last._h")) | ((F.col("_h") == F.col("_last._h")) & (last <= F.col("_last"))), "train").otherwise("val")
    return out.select(group, *key, *[c for c in df.columns if c not in (group, *key)], side.alias("side"))


def split_hashed(df: DataFrame, key: list[str], seed: str, percent: int = 90) -> DataFrame:
    """df with side by the key's hash alone: no shuffle, shares in expectation."""
    return df.withColumn("side", F.when(hashed(seed, *map(F.col, key)) % 100 < percent, "train").otherwise("val"))


def length_buckets(df: DataFrame, length: Column, width: int) -> DataFrame:
    """df with bucket: rows of like length together, for batches without much padding."""
    return df.withColumn("bucket", F.floor(length / width).cast("long"))
