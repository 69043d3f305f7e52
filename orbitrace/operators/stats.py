"""Per-track statistics, binning, sampling, bootstrap, learned classes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.operators.tracks import centered_rows
from orbitrace.session import materialize, tasks_for

#: Distinct values whose counts are summed up in one group.
RANK_BLOCK = 100_000


def cells_per_class(tracks: DataFrame, classes=(0, 1, 2)) -> DataFrame:
    """Cells per frame and class; a frame without a class has a row with 0."""
    frames = tracks.select("t").distinct().withColumn("track_class", F.explode(F.array(*(F.lit(c) for c in classes))))
    n = tracks.groupBy("t", "track_class").agg(F.countDistinct("track_id").alias("n"))
    return frames.join(n, ["t", "track_class"], "left").select("t", "track_class", F.coalesce("n", F.lit(0)).alias("n"))


def track_class(frame_scores: DataFrame, scores=("logL0", "logL1", "logL2")) -> DataFrame:
    """Mean log-likelihoods per track and the index of the largest (the first of equals)."""
    out = frame_scores.groupBy("track_id").agg(*(F.avg(s).alias(f"track_{s}") for s in scores))
    means = F.array(*(F.col(f"track_{s}") for s in scores))
    return out.withColumn("track_class", F.array_position(means, F.array_max(means)) - 1)


def track_means(tracks: DataFrame, columns, least: int = 50) -> DataFrame:
    return tracks.groupBy("track_id").agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), F.count("*").alias("n")).where(F.col("n") > least)


def track_spans(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.countDistinct("t").alias("n_frames"))


def percentiles_by(df: DataFrame, group: str, value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean, two exact percentiles and the number of rows per group; null values count in ``n`` alone, as does a group of them."""
    rows = materialize(df.select(group, value), "values")
    per = rows.groupBy(F.struct(group).alias("__g")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    cuts = grouped_quantiles(rows, [group], value, {"p_low": low, "p_high": high})
    out = per.join(cuts.withColumn("__g", F.struct(group)).drop(group), "__g", "left")
    return out.select(f"__g.{group}", "mean", "p_low", "p_high", "n")


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` (distinct, non-null values of ``column``) with the rank of each value, from 0, as ``name``.

    Values are dealt in ranges and ranked inside a range; the ranges' row counts give each range its start. The ranks
    of one range are one task, never those of the table. A value's range is written down first, as sampling chooses the
    bounds anew in every run.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, column).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # at most one row a partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = inside.join(F.broadcast(before.select("__part", "__before")), "__part")
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def running_counts(counts: DataFrame, column: str) -> DataFrame:
    """``counts`` (distinct values of ``column``, with how often each occurs as ``__c``) and ``__first``: the rows before a value.

    Values are ranked along ranges and their counts summed up inside blocks of ranks, after the sums of the blocks before.
    """
    ranked = materialize(numbered(counts, column, "__rank"), "ranked")
    block = F.floor(F.col("__rank") / RANK_BLOCK)
    sums = ranked.groupBy(block.alias("__b")).agg(F.sum("__c").alias("__s"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # one row for every RANK_BLOCK distinct values
    starts = sums.select("__b", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__b").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranked.withColumn("__b", block).join(starts, "__b").withColumn("__first", F.col("__base") + F.coalesce(F.sum("__c").over(within), F.lit(0)))
    return runs.drop("__b", "__base", "__rank")


def grouped_quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` and one column for every share: the exact quantile of the group's values, with linear interpolation.

    Equal values of a group are counted first. All (group, value) pairs are then ranked together along ranges, so a group's
    values have running counts without being in one task; its first one tells where the group begins, and the values asked
    for are those whose runs hold the places. No buffer holds a group, however large it is. Null values are left out, and
    a group of nothing else with them; null groups are groups.
    """
    key = F.struct(F.struct(*group).alias("g"), F.col(value).cast("double").alias("v"))
    counts = df.where(F.col(value).isNotNull()).groupBy(key.alias("__k")).agg(F.count("*").alias("__c"))
    runs = materialize(running_counts(counts, "__k"), "runs")
    whole = runs.groupBy(F.col("__k.g").alias("g")).agg(F.min("__first").alias("__start"), F.sum("__c").alias("__n"))
    ends = lambda s: (F.floor(F.lit(float(s)) * (F.col("__n") - 1)), F.ceil(F.lit(float(s)) * (F.col("__n") - 1)))
    asked = F.array(*(F.struct(F.lit(i * 2 + k).alias("i"), (F.col("__start") + p).alias("p")) for i, s in enumerate(shares.values()) for k, p in enumerate(ends(s))))
    rows = runs.select(F.col("__k.g").alias("g"), F.col("__k.v").alias("v"), "__first", "__c").join(whole.withColumn("__asked", asked), "g")
    hit = rows.withColumn("__hit", F.filter("__asked", lambda p: (p["p"] >= F.col("__first")) & (p["p"] < F.col("__first") + F.col("__c")))).where(F.size("__hit") > 0)
    found = hit.select("g", "__n", "v", F.explode("__hit.i").alias("i")).groupBy("g").agg(
        F.max("__n").alias("__n"), *(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"__v{i}") for i in range(2 * len(shares)))
    )
    cut = lambda i, s: F.col(f"__v{2 * i}") + (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) * (F.lit(float(s)) * (F.col("__n") - 1) - F.floor(F.lit(float(s)) * (F.col("__n") - 1)))
    return found.select(*(F.col(f"g.{c}").alias(c) for c in group), *(cut(i, s).alias(c) for i, (c, s) in enumerate(shares.items())))


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation; an empty list where there are no values. What comes to the driver is one row."""
    names = {f"q{i}": s for i, s in enumerate(shares)}
    found = grouped_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, names).first()
    return [found[n] for n in names] if found else []


def quantile_bins(df: DataFrame, value: str, bins: int, summary: str) -> DataFrame:
    """Bins between exact quantiles, closed on the right, the lowest value in the first: ``bin, n, median, mean``.

    Null values go to no bin; an empty table gives no bins. The medians too are exact ranks along ranges.
    """
    edges = F.array(*map(F.lit, exact_quantiles(df, value, [k / bins for k in range(bins + 1)]))).cast("array<double>")
    b = F.greatest(F.size(F.filter(edges, lambda x: x < F.col(value))) - 1, F.lit(0))
    rows = materialize(df.where(F.col(value).isNotNull()).select(b.alias("bin"), F.col(summary).alias("s")), "bins")
    middle = grouped_quantiles(rows, ["bin"], "s", {"median": 0.5})
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("mean")).join(middle, "bin", "left").select("bin", "n", "median", "mean")


def time_bins(df: DataFrame, time: str, edges, value: str) -> DataFrame:
    """Bins between given edges, closed on the right; times outside them go."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        b = F.when((F.col(time) > edges[k]) & (F.col(time) <= edges[k + 1]), k).otherwise(b)
    return df.withColumn("bin", b).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def fluorescent_count(tracks: DataFrame, threshold: float, width: int = 50) -> DataFrame:
    """Bright cells per frame and their trailing mean."""
    n = tracks.groupBy("t").agg(F.sum((F.col("mean_fluo") > threshold).cast("long")).alias("n_bright"))
    return n.withColumn("rolling", F.avg("n_bright").over(Window.orderBy("t").rowsBetween(-(width - 1), 0)))  # one row a frame


def top_per_frame(tracks: DataFrame, value: str, n: int) -> DataFrame:
    order = Window.partitionBy("t").orderBy(F.desc(value), "track_id")
    return tracks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def display_bounds(field: DataFrame, value: str, low: float = 0.01, high: float = 0.975, frame: str = "t") -> DataFrame:
    """Two percentiles of the last frame's finite positive values."""
    last = field.agg(F.max(frame).alias(frame))  # one row
    rows = field.join(F.broadcast(last), frame, "left_semi").where((F.col(value) > 0) & ~F.isnan(value))
    return rows.agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))


def _uniform(seed: int, *keys):
    """Column: a number in (0, 1) made from keys and a seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, n: int, weight, keys, seed: int = 0, group=()) -> DataFrame:
    """``n`` rows without replacement with chances by weight, per group if given (exponential keys)."""
    w = weight if not isinstance(weight, str) else F.col(weight)
    drawn = df.where(w > 0).withColumn("__k", -F.log(_uniform(seed, *keys)) / w)
    if not group:
        return drawn.orderBy("__k", *keys).limit(n).drop("__k")
    order = Window.partitionBy(*group).orderBy("__k", *keys)
    return drawn.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__k", "__r")


def bootstrap_mean(df: DataFrame, value: str, entity: str, replicates: int = 200, seed: int = 0, group=()) -> DataFrame:
    """Mean and its bootstrap error over entities, by Poisson(1) weights from a seeded hash; one pass, no resampled table."""
    per = df.groupBy(*group, entity).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    rows = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u, p, total, w = _uniform(seed, entity, "rep"), math.exp(-1), 0.0, F.lit(0)
    for k in range(8):
        total += p
        w = w + (F.col("__u") > total).cast("int")
        p /= k + 1
    rep = rows.withColumn("__u", u).withColumn("w", w).groupBy(*group, "rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m"))
    band = rep.groupBy(*group).agg(F.stddev_samp("m").alias("error"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    mean = per.groupBy(*group).agg((F.sum("s") / F.sum("c")).alias("mean"))
    return mean.join(band, list(group)) if group else mean.join(F.broadcast(band))


def group_variances(df: DataFrame, group, value: str, order: str) -> DataFrame:
    """Sample variance per group of the value, and of the difference of consecutive rows."""
    along = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("__d", F.col(value) - F.lag(value).over(along)).groupBy(*group).agg(F.var_samp(value).alias("var_base"), F.var_samp("__d").alias("var_seq"), F.count("*").alias("n"))


def gaussian_entropy(variances: DataFrame, group, variance: str = "var") -> DataFrame:
    """``k/2 ln(2 pi e) + 1/2 sum ln var`` over the ``k`` dimensions of each group."""
    return variances.where(F.col(variance) > 0).groupBy(*group).agg((F.count("*") / 2 * math.log(2 * math.pi * math.e) + F.sum(F.log(variance)) / 2).alias("entropy"), F.count("*").alias("k"))


def trend(df: DataFrame, group: str, order: str, value: str, least: int = 3) -> DataFrame:
    """Value replaced by its regression on the row number in groups of at least ``least`` rows."""
    along, whole = Window.partitionBy(group).orderBy(order), Window.partitionBy(group)
    rows = df.withColumn("__i", (F.row_number().over(along) - 1).cast("double"))
    out = rows.withColumns({"__n": F.count("*").over(whole), "__m": F.avg("__i").over(whole), "__v": F.avg(value).over(whole)})
    slope = F.sum((F.col("__i") - F.col("__m")) * (F.col(value) - F.col("__v"))).over(whole) / F.sum((F.col("__i") - F.col("__m")) ** 2).over(whole)
    return out.withColumn(f"{value}_trend", F.when(F.col("__n") >= least, F.col("__v") + slope * (F.col("__i") - F.col("__m"))).otherwise(F.col(value))).drop("__i", "__n", "__m", "__v")


def category_ids(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a dense id of the column's values in their order, from 0; only distinct values are ranked, by ranges.

    Rows with a null value go.
    """
    ids = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), column, f"{column}_id")
    return df.join(ids, column)


def sequential_pairs(snips: DataFrame, entity: str, condition: str, age: str, window: float, key: str, self_weight: float = 0.5) -> DataFrame:
    """Pairs of one condition whose ages differ by at most ``window``: the pair's kind (self or other), a weight that
    shares ``self_weight`` among a snip's own entity, and a penalty that grows with the age difference.

    Ages are cut into buckets as wide as the window, so a snip meets three buckets only. The pairs of a snip are counted
    before they are made, so no pair is shuffled or written but as the result; their number grows with the square of a bucket.
    """
    # a bucket is much work for few bytes, so small partitions are not put together, and neither side is broadcast
    parts = tasks_for(3 * snips.count(), snips)
    keys = [condition, "__b"]
    a = snips.select(key, entity, condition, age, F.floor(F.col(age) / window).alias("__b"))
    b = a.select(F.col(key).alias("n_key"), F.col(entity).alias("n_entity"), condition, F.col(age).alias("n_age"), F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__b"))
    b = b.repartition(parts, *keys)

    def met(left):
        p = left.repartition(parts, *keys).join(b.hint("merge"), keys).where((F.col(key) != F.col("n_key")) & (F.abs(F.col(age) - F.col("n_age")) <= window))
        return p.withColumn("is_self", F.col(entity) == F.col("n_entity"))

    own = F.col("is_self")
    n = met(a).groupBy(key).agg(F.count_if(own).alias("__own"), F.count_if(~own).alias("__other"), F.count_if(own.isNull()).alias("__untold"))
    p = met(a.join(materialize(n, "counts"), key))
    many = F.when(own, F.col("__own")).when(~own, F.col("__other")).otherwise(F.col("__untold"))
    share = F.when(own, self_weight).otherwise(1 - self_weight)
    return p.select(F.col(key), "n_key", "is_self", (share / many).alias("weight"), (F.abs(F.col(age) - F.col("n_age")) / window).alias("penalty"))


def rolling_band(series: DataFrame, value: str, width: int, order: str = "t") -> DataFrame:
    """Centred rolling mean over a table with one row per time."""
    return series.withColumn(f"{value}_roll", F.avg(value).over(centered_rows(width, Window.orderBy(order))))


def mixture(df: DataFrame, columns, k: int = 2, seed: int = 7) -> DataFrame:
    """Gaussian mixture on columns centred and scaled by the 95th percentile of their size: ``component``, the
    ``probability`` of every component, and the ``log_likelihood`` of the whole fit. Rows need all columns non-null."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # it is read several times
    df = materialize(df, "mixture")
    scale = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns)).first()
    centered = df.select("*", *((F.col(c) - scale[f"m_{c}"]).alias(f"__{c}") for c in columns))
    # a scale only: the rank is right to one part in ten thousand, and one pass does for all columns
    size = centered.agg(*(F.percentile_approx(F.abs(f"__{c}"), 0.95, 10_000).alias(c) for c in columns)).first()
    scaled = centered.withColumns({f"__{c}": F.col(f"__{c}") / (size[c] or 1.0) for c in columns})
    x = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__x").transform(scaled)
    model = GaussianMixture(featuresCol="__x", k=k, seed=seed, predictionCol="component", probabilityCol="probability").fit(x)
    out = model.transform(x).drop("__x", *(f"__{c}" for c in columns))
    return out.withColumns({"probability": vector_to_array("probability"), "log_likelihood": F.lit(float(model.summary.logLikelihood))})


def forest(train: DataFrame, score: DataFrame, features, label: str, seed: int = 7, trees: int = 20) -> DataFrame:
    """Random forest fitted on ``train``; ``score`` with ``predicted`` and log-probabilities ``log_p``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=list(features), outputCol="__x")
    model = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, seed=seed, predictionCol="predicted", probabilityCol="__p").fit(va.transform(train))
    out = model.transform(va.transform(score)).withColumn("log_p", F.transform(vector_to_array("__p"), lambda p: F.log(F.greatest(p, F.lit(1e-12)))))
    return out.drop("__x", "__p", "rawPrediction")


def held_out_accuracy(df: DataFrame, features, label: str, key: str, seed: int = 7, trees: int = 20) -> DataFrame:
    """``n, accuracy`` of a forest that is fitted on four fifths of the rows (by a hash of ``key``) and scored on the rest."""
    held = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(5)) == 0
    scored = forest(df.where(~held), df.where(held), features, label, seed, trees)
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))


def paired_variances(df: DataFrame, group, value: str, pair: str) -> DataFrame:
    """Sample variance per group of the value, and of the difference between the two rows that share ``pair``.

    A pair that does not have exactly two rows of the group takes no part in the second one; null values take part in none.
    """
    own = df.groupBy(*group).agg(F.var_samp(value).alias("var_base"), F.count(value).alias("n"))
    two = df.where(F.col(value).isNotNull()).groupBy(*group, pair).agg(F.count("*").alias("k"), (F.max(value) - F.min(value)).alias("d")).where("k = 2")
    # either order of a pair is as good, so the variance is about zero
    diff = two.groupBy(*group).agg((F.sum(F.col("d") * F.col("d")) / F.count("*")).alias("var_pair"), F.count("*").alias("n_pairs"))
    return own.join(diff, list(group), "left").select(*group, "var_base", "var_pair", "n", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def entropy_by_class(variances: DataFrame, group, kind: str, errors: DataFrame | None = None, variance: str = "var") -> DataFrame:
    """Gaussian entropy per group, one column ``entropy_<kind>`` for every kind of variance, and the group's mean ``error``."""
    each = gaussian_entropy(variances.withColumn("__kind", F.col(kind)), [*group, "__kind"], variance)
    wide = each.groupBy(*group).pivot("__kind").agg(F.first("entropy"))
    wide = wide.withColumnsRenamed({c: f"entropy_{c}" for c in wide.columns if c not in group})
    return wide if errors is None else wide.join(errors.groupBy(*group).agg(F.avg("error").alias("error")), list(group), "left")


def bootstrap_band(df: DataFrame, value: str, entity: str, width: int, replicates: int = 100, seed: int = 0, order: str = "t") -> DataFrame:
    """``t, mean, low, high``: the centred rolling mean over time of the mean value, and the 2.5 and 97.5 percentiles of the
    same over replicates in which every entity has a Poisson(1) weight from a seeded hash."""
    u, p, total, w = F.col("__u"), math.exp(-1), 0.0, F.lit(0)
    for k in range(8):
        total += p
        w = w + (u > total).cast("int")
        p /= k + 1
    rows = df.select(entity, order, value).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("__u", _uniform(seed, entity, "rep"))
    # replicate 0 is the sample itself
    rows = rows.withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(w))
    per = rows.groupBy("rep", order).agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col("w")))).alias("m"))
    rolled = per.withColumn("m", F.avg("m").over(centered_rows(width, Window.partitionBy("rep").orderBy(order))))
    own = F.max(F.when(F.col("rep") == 0, F.col("m")))
    other = F.when(F.col("rep") > 0, F.col("m"))
    return rolled.groupBy(order).agg(own.alias("mean"), F.percentile(other, 0.025).alias("low"), F.percentile(other, 0.975).alias("high"))
