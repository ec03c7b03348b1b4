"""Mixing sources to target weights by entropy balancing.

Rates stay as close to 1 as the targets allow: they minimise the relative entropy to uniform
rates subject to each source's token constraint. The dual is convex with one multiplier a
source, and its solution tilts exponentially: a document of s words has the rate
exp(multiplier * s / mean size of its source), at most `most` copies. Newton steps, kept inside
a bracket, solve the dual. They run on the counts of equal (source, size) pairs, which are
exact and small however many rows a source has.

Rates become whole copies: every document gets the whole part, and the fractional part against
a hash of the document decides on one more. Rows that repeat id, text and source are counted as
one and spread evenly over the hash's range, so that a share of them is taken. A threshold for each
source, found by two rounds of histograms over those hashes, makes the copies' words meet the
target to about one document. What is then missing or too much is closed by single copies: from
the largest size that still fits downwards, of each size those with the least hashes, one copy more
(or less) for each. So no document is left that would bring its source nearer to the target. If the
dual is not solved after `ROUNDS` steps, `mix` fails.

Everything is DataFrame code. Sources are numbered by ranges, so no task sees all of them, and
the join of documents with their source's numbers is salted unless the sources are few.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source
of its own, numbered last; repeated rows are numbered by `nth` and decided one by one; without any
words all targets are 0. Only the three named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import keyed_columns, numbered_copies, scratch_space, stored, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
ROUNDS, TOLERANCE, BINS = 60, 1e-9, 4096
#: Sources up to which their table is broadcast (under a megabyte), and salts beyond.
FEW_SOURCES, SALTS = 10_000, 32

WORDS = "[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, kd, th, source, size, u, nth): the row's key, a number in [0, 1) and which of its repetitions it is.

    Equal rows are counted and written out again, a row for each.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    own = keyed_columns(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), own["__kd"].alias("kd"), own["__th"].alias("th"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    u = F.shiftrightunsigned(F.xxhash64("kd", "th"), 11) / float(1 << 53)
    spread = numbered_copies(each, "n", "nth")
    return spread.select(*rows.columns, F.pmod(u + F.col("nth") / F.col("n"), F.lit(1.0)).alias("u"), "nth")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 in code point order with null last, by ranges and their counts."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sources.repartitionByRange(parts, F.isnull("source"), F.col("source")).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").count().withColumn("before", F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.row_number().over(W.partitionBy("range").orderBy(F.isnull("source"), "source")) - 1
    return ranged.join(counts, "range").select(*sources.columns, (inside + F.coalesce("before", F.lit(0))).alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds `target` to (source, total): words by weight, at most `most` times the total, the excess reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(numbered(sources).select(*sources.columns, weight.alias("weight"), (F.col("total") * float(most)).alias("cap")), "sources")
    wanted = share * (rows.agg(F.sum("total")).head()[0] or 0)
    level = 0.0
    while True:  # the level rises until no further source is above its cap
        full = F.col("cap") <= F.col("weight") * level
        capped, free = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).head()
        following = (wanted - capped) / free if free else math.inf
        if not free or following <= level * (1 + 1e-12):
            break
        level = following
    target = F.least("cap", F.col("weight") * level) if math.isfinite(level) else F.col("cap")
    return rows.select(*sources.columns, target.alias("target"))


def rate(multiplier: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(multiplier * size / mean, F.lit(100.0))))


def solve(sources: DataFrame, histogram: DataFrame, few: bool, most: float = MOST, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `multiplier` to (source, total, documents, target), by Newton steps on (source, size, n).

    few: the sources are few enough to be broadcast and kept in one file between the steps.
    """
    near_ = F.broadcast if few else lambda df: df
    kept = lambda df: stored(df.coalesce(1) if few else df, "multipliers")
    # for targets at the cap, the multiplier at which even one word reaches the highest rate
    highest = F.col("mean") * math.log(most) * 1.001
    rows = sources.withColumn("mean", F.greatest(F.col("total") / F.greatest("documents", F.lit(1)), F.lit(1e-9)))
    full = F.col("target") >= F.col("total") * most * (1 - 1e-12)
    state = rows.withColumns({"multiplier": F.when(full, highest).otherwise(0.0), "low": F.lit(-200.0) * F.greatest(F.lit(1.0), "mean"), "high": highest, "done": full})
    state = kept(state)
    for _ in range(rounds):
        if state.where("NOT done").isEmpty():
            return state.select(*rows.columns, "multiplier")
        open_ = state.where("NOT done")
        joined = histogram.join(near_(open_.select(F.col("source").alias("s"), "multiplier", "mean")), F.col("source").eqNullSafe(F.col("s")))
        words = F.col("n") * F.col("size")
        r = rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
        slope = F.when(r < most, words * r * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.groupBy("s").agg(F.sum(words * r).alias("now"), F.sum(slope).alias("slope"))
        both = state.join(near_(sums), F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.col("now") - F.col("target")
        near = F.col("done") | F.col("now").isNull() | (F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0)))
        low, high = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        inside = (step > low) & (step < high)
        moved = F.when(near, F.col("multiplier")).when(inside, step).otherwise((low + high) / 2)
        state = kept(both.select(*rows.columns, moved.alias("multiplier"), low.alias("low"), high.alias("high"), near.alias("done")))
    if not state.where("NOT done").isEmpty():
        raise RuntimeError(f"the dual is not solved to {tolerance} within {rounds} steps")
    return state.select(*rows.columns, "multiplier")


def with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Joins rows with their source's columns; a hot source is dealt over salts unless sources are few."""
    named = sources.withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    if few:
        return rows.join(F.broadcast(named), same).drop("s")
    salted = named.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.floor(F.col("u") * 1e6).cast("int") % SALTS
    return rows.withColumn("salt", salt).join(salted, same & (F.col("salt") == F.col("salt2"))).drop("s", "salt", "salt2")


def cuts(rows: DataFrame, need: DataFrame, bin_col: str) -> DataFrame:
    """For each source the bin in which the words taken in order of bins reach `need`, and what is still needed there."""
    sums = rows.groupBy("source", bin_col).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy(bin_col))
    cumulated = sums.withColumn("upto", upto).join(need.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    crossed = cumulated.where(F.col("upto") >= F.col("need")).groupBy("source").agg(F.min_by(F.struct(bin_col, "words", (F.col("need") - F.col("upto") + F.col("words")).alias("left")), bin_col).alias("c"))
    return crossed.select("source", F.col(f"c.{bin_col}").alias("cut"), F.col("c.left").alias("need"), F.col("c.words").alias("inside"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, kd, th, source, size, u, nth, source_size, target, rate, copies) of every row."""
    with scratch_space(docs.sparkSession) as keep:
        rows = stored(sized(docs, id_col, source_col, text_col), "sizes")
        return keep(stored(closed(stored(_mixed(rows, weights, share, most), "rounded"), most), "mixed"))


def closed(rows: DataFrame, most: int) -> DataFrame:
    """The rows with a copy more or less for some, so that no further one would bring its source nearer to the target."""
    gaps = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    gaps = stored(gaps.select("source", F.when(F.col("gap") < 0, -1).otherwise(1).alias("sign"), F.floor(F.abs("gap")).alias("gap")).where("gap > 0"), "gaps")
    few = gaps.count() <= FEW_SOURCES
    room = F.when(F.col("sign") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    useful = lambda df: with_source(df, gaps, few).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & room)
    order = F.struct("u", "kd", "th", "nth")
    fit = useful(rows)
    sizes = fit.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"), F.first("sign").alias("sign"))
    # down the sizes of a source, at most as many as its gap has words; the gap is halved or a size used up by each that is taken
    start = F.struct(F.first("gap").alias("gap"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("taken"))
    down = F.reverse(F.array_sort(F.collect_list(F.struct("size", "n"))))
    by_source = sizes.groupBy("source").agg(down.alias("sizes"), start.alias("start"))

    def step(state: Column, x: Column) -> Column:
        k = F.least(x["n"], F.floor(state["gap"] / x["size"]))
        taken = F.when(k > 0, F.concat(state["taken"], F.array(F.struct(x["size"].alias("size"), k.alias("k"))))).otherwise(state["taken"])
        return F.struct((state["gap"] - k * x["size"]).alias("gap"), taken.alias("taken"))

    chosen = by_source.select("source", F.explode(F.aggregate("sizes", F.col("start"), step)["taken"]).alias("t")).select("source", F.col("t.size").alias("size"), F.col("t.k").alias("k"))
    chosen = stored(chosen, "closing")
    highest = chosen.agg(F.max("k")).head()[0]
    if not highest:
        return rows
    near = F.broadcast if few else lambda df: df
    named = chosen.select(F.col("source").alias("s"), F.col("size").alias("z"), "k")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    # at most `highest` of a source and size leave a task, which is less than a gap has words
    ranked = fit.join(near(named), same).select("source", "size", "k", order.alias("o")).withColumn("rank", F.row_number().over(W.partitionBy("source", "size").orderBy("o"))).where(F.col("rank") <= highest)
    upto = stored(ranked.where(F.col("rank") == F.col("k")).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("o").alias("upto")), "closing-limits")
    signs = near(gaps.select(F.col("source").alias("g"), "sign"))
    out = rows.join(near(upto), same, "left").join(signs, F.col("source").eqNullSafe(F.col("g")), "left")
    moved = F.when(F.coalesce(room & (order <= F.col("upto")), F.lit(False)), F.col("sign")).otherwise(0)
    return out.select(*[c if c != "copies" else (F.col("copies") + moved).alias("copies") for c in rows.columns])


def _mixed(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    histogram = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("documents"))
    wanted = stored(targets(sources, weights, share, most), "targets")
    few = wanted.count() <= FEW_SOURCES
    solved = solve(wanted, histogram, few, most)
    keep = [c for c in rows.columns]
    r = rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
    rated = with_source(rows, solved.select("source", "total", "target", "mean", "multiplier"), few).withColumn("rate", F.when(F.col("size") > 0, r).otherwise(0.0))
    rated = rated.withColumns({"whole": F.floor("rate"), "z": F.when(F.col("rate") < most, (F.col("u") - F.col("rate") + F.floor("rate") + 1) / 2)})
    bin1, rest = F.floor(F.col("z") * BINS), F.col("z") * BINS - F.floor(F.col("z") * BINS)
    rated = rated.withColumns({"bin1": bin1, "bin2": F.floor(rest * BINS)})
    given = rated.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("whole"))).alias("need"))
    open_ = rated.where("z IS NOT NULL AND size > 0")
    first = stored(cuts(open_, given, "bin1"), "first-cuts")
    inside = with_source(open_.select("source", "size", "u", "bin1", "bin2"), first, few).where("bin1 = cut")
    second = cuts(inside.select("source", "size", "bin2"), first.select("source", "need"), "bin2")
    # the bin that crosses the target is taken if that comes nearer
    second = second.select(F.col("source").alias("t"), (F.col("cut") + (F.col("need") * 2 >= F.col("inside")).cast("long")).alias("cut2"))
    limits = first.join(second, F.col("source").eqNullSafe(F.col("t")), "left").select("source", F.col("cut").alias("cut1"), F.coalesce("cut2", F.lit(0)).alias("cut2"))
    limits = solved.select("source").join(limits.withColumnRenamed("source", "l"), F.col("source").eqNullSafe(F.col("l")), "left").drop("l")
    limits = stored(limits, "cuts")
    final = with_source(rated, limits, few)
    before = (F.col("bin1") < F.col("cut1")) | ((F.col("bin1") == F.col("cut1")) & (F.col("bin2") < F.col("cut2")))
    # no cut: the sum of all falls short of the target by rounding, so everything is taken, or nothing is needed
    extra = F.when(F.col("size") == 0, 0).when(F.col("z").isNull(), 0).when(F.coalesce(before, F.lit(False)), 1).otherwise(0)
    return final.select(*keep, F.col("total").alias("source_size"), "target", "rate", (F.col("whole") + extra).alias("copies"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
