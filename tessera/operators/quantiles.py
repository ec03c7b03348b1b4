"""Exact quantiles of groups of any size, by rounds of counts that close in on the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Bins that an interval is divided into each round, and groups times shares that are broadcast.
BINS, FEW = 64, 20_000


def exact_quantiles(df: DataFrame, by: str, value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """(by, share, n, quantile): the least value at or below which a share of a group's values lies.

    Each group and share has an interval of values that holds its rank, at first all of them. A round
    cuts the interval at approximate quantiles of the values in it, counts the values of each bin
    exactly, and goes on with the values of the bin that holds the rank; it ends when those are one value.
    So a round leaves about one in `bins` of the values, whatever their distribution, and at least one
    value less. Both steps are combined before the shuffle, so a task holds counts of bins and small
    sketches, however many values a group has. Null values and NaN are no values; a null group is a group.
    """
    rows = df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    groups = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share"))).cast("long")
    state = written(state.select("by", "share", "n", rank.alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"), "intervals")
    near = F.broadcast if state.count() <= FEW else lambda x: x
    while not (open_ := state.where("lo < hi")).isEmpty():
        asked = open_.select(F.col("by").alias("g"), "share", "lo", "hi")
        inside = rows.join(near(asked), F.col("by").eqNullSafe(F.col("g"))).where("v >= lo AND v <= hi")
        cuts = inside.groupBy("by", "share").agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 1000).alias("cuts"), F.min("v").alias("least"))
        cuts = written(cuts.select(F.col("by").alias("g"), F.col("share").alias("s"), F.array_distinct(F.concat(F.array("least"), "cuts")).alias("cuts")), "cuts")
        cut = inside.drop("g").join(near(cuts), F.col("by").eqNullSafe(F.col("g")) & (F.col("share") == F.col("s")))
        place = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        counted = cut.groupBy("by", "share", place.alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = counted.withColumn("upto", F.sum("k").over(W.partitionBy("by", "share").orderBy("bin")))
        told = upto.join(near(open_.select(F.col("by").alias("g"), F.col("share").alias("s"), "n", "rank", "below")), F.col("by").eqNullSafe(F.col("g")) & (F.col("share") == F.col("s")))
        told = told.where((F.col("below") + F.col("upto") >= F.col("rank")) & (F.col("below") + F.col("upto") - F.col("k") < F.col("rank")))
        moved = told.select("by", "share", "n", "rank", (F.col("below") + F.col("upto") - F.col("k")).alias("below"), "lo", "hi")
        state = written(moved.unionByName(state.where("lo = hi")), "intervals")
    return state.select("by", "share", "n", F.col("lo").alias("quantile"))
