"""Matching of predictions to truth, detection and tracking scores, and statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.geometry import box_edges, edges_overlap


def overlap_candidates(truth: DataFrame, predicted: DataFrame, key: list[str], least: float = 0.5) -> DataFrame:
    """``key, t, p, score, iou``: pairs of boxes of a frame that overlap enough (equi join on the frame).

    Edges and areas are computed once a box, not once a pair, and most pairs end at the first
    comparison; so the join condition stays small enough for the JVM to compile.
    """
    a = truth.select(*key, F.col("id").alias("t"), *box_edges(F.col("box"), "_t"))
    b = predicted.select(*key, F.col("id").alias("p"), "score", *box_edges(F.col("box"), "_p"))
    common, iou = edges_overlap("_t", "_p")
    enough = (common > 0) & (iou >= least) if least > 0 else F.greatest(F.lit(0.0), iou) >= least
    return a.join(b, key).where(enough).select(*key, "t", "p", "score", F.greatest(F.lit(0.0), iou).alias("iou"))


def greedy_matches(candidates: DataFrame, key: list[str], by: str = "iou") -> DataFrame:
    """One-to-one matches per frame, best first: by overlap, or by score and then overlap.

    Rows are laid out by frame and sorted; one pass over the batches of a task keeps only the
    boxes used in the current frame, so many frames share a batch and none is gathered.
    """
    best = [F.desc("iou")] if by == "iou" else [F.desc("score"), F.desc("iou")]
    slim = candidates.select(*key, "t", "p", "score", "iou").repartition(*key).sortWithinPartitions(*key, *best, "t", "p")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used_t, used_p = None, set(), set()
        for batch in batches:
            kept = []
            for i, (where, t, p) in enumerate(zip(zip(*[batch[k] for k in key]), batch["t"], batch["p"])):
                if where != current:
                    current, used_t, used_p = where, set(), set()
                if t not in used_t and p not in used_p:
                    used_t.add(t)
                    used_p.add(p)
                    kept.append(i)
            yield batch.iloc[kept]

    return slim.mapInPandas(match, slim.schema)


def best_overlap(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Many-to-one attachment: for every prediction the truth it overlaps most, ties to the smaller."""
    best = F.max(F.struct("iou", (-F.col("t")).alias("_t"))).alias("b")
    return candidates.groupBy(*key, "p").agg(best).select(*key, "p", (-F.col("b._t")).alias("t"), F.col("b.iou").alias("iou"))


def average_precision(predicted: DataFrame, truth: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """``key, ap``: eleven-point interpolated precision of every frame with truth."""
    hit = matches.select(*key, "p", F.lit(1).alias("hit"))
    size = truth.groupBy(*key).agg(F.count("*").alias("n"))
    ranked = predicted.select(*key, F.col("id").alias("p"), "score").join(hit, [*key, "p"], "left").join(size, key)
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "p")
    curve = ranked.select(*key, (F.sum(F.coalesce("hit", F.lit(0))).over(w) / F.row_number().over(w)).alias("precision"), (F.sum(F.coalesce("hit", F.lit(0))).over(w) / F.col("n")).alias("recall"))
    levels = [k * 0.1 for k in range(11)]
    parts = [F.coalesce(F.max(F.when(F.col("recall") >= t, F.col("precision"))), F.lit(0.0)).alias(f"_{k}") for k, t in enumerate(levels)]
    ap = sum((F.col(f"_{k}") for k in range(1, 11)), F.col("_0")) / 11
    return size.select(*key).join(curve.groupBy(*key).agg(*parts).select(*key, ap.alias("ap")), key, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def tracking_counts(truth: DataFrame, predicted: DataFrame, matches: DataFrame, sequence: str, order: str) -> DataFrame:
    """``sequence, truth, misses, false_positives, switches, mota`` of every sequence."""
    w = Window.partitionBy(sequence, "t").orderBy(order)
    switched = matches.withColumn("_s", (F.lag("p").over(w) != F.col("p")).cast("int"))
    m = switched.groupBy(sequence).agg(F.count("*").alias("m"), F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"))
    out = truth.groupBy(sequence).agg(F.count("*").alias("truth")).join(predicted.groupBy(sequence).agg(F.count("*").alias("predicted")), sequence, "left").join(m, sequence, "left").na.fill(0)
    misses, false = F.col("truth") - F.col("m"), F.col("predicted") - F.col("m")
    return out.select(sequence, "truth", misses.alias("misses"), false.alias("false_positives"), "switches", (1 - (misses + false + F.col("switches")) / F.col("truth")).alias("mota"))


def with_truth(predicted: DataFrame, truth: DataFrame, matches: DataFrame, key: list[str], attributes: Iterable[str]) -> DataFrame:
    """Predictions with the attributes of their matched truth (a null of the truth too); others keep their own."""
    real = matches.select(*key, F.col("p").alias("id"), "t").join(truth.select(*key, F.col("id").alias("t"), *[F.col(a).alias(f"_{a}") for a in attributes]), [*key, "t"])
    joined = predicted.join(real.withColumn("_matched", F.lit(True)), [*key, "id"], "left")
    return joined.select(*[F.when(F.col("_matched"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in attributes else F.col(c) for c in predicted.columns])


def bootstrap(values: DataFrame, unit: str, metrics: list[str], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """``metric, mean, low, high``: 95 % interval of the mean under resampling of units.

    Every unit draws its Poisson(1) count per replicate from a hash, so nothing is gathered:
    one explode, one partial aggregation, one percentile over the replicates.
    """
    reps = values.select(unit, *metrics, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    u = (F.pmod(F.xxhash64(F.col(unit), F.col("rep"), F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    cumulative, total = 0.0, F.lit(0)
    for k in range(8):
        cumulative += math.exp(-1) / math.factorial(k)
        total = total + (u > cumulative).cast("int")
    drawn = reps.withColumn("_c", total)
    means = drawn.groupBy("rep").agg(*[F.try_divide(F.sum(F.col(m) * F.col("_c")), F.sum(F.when(F.col(m).isNotNull(), F.col("_c")))).alias(m) for m in metrics])
    long = means.unpivot("rep", metrics, "metric", "value")
    point = values.agg(*[F.avg(m).alias(m) for m in metrics]).unpivot([], metrics, "metric", "mean")
    bounds = long.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    return point.join(bounds, "metric")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p = F.try_divide(hits, n)
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / scale, (centre + half) / scale


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact McNemar test of b against c discordant pairs."""
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, n, p50, p95, p99, mean, cv``: percentiles with linear interpolation, and the coefficient of variation."""
    at = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.avg(value).alias("mean"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"))


def running_summary(rows: DataFrame, by: list[str], order: list[str], value: str, last: int = 200) -> DataFrame:
    """The rows with median and 95th percentile of the last ``last`` values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.select("*", F.percentile(value, F.lit(0.5)).over(w).alias("p50"), F.percentile(value, F.lit(0.95)).over(w).alias("p95"))


def peak_rate(samples: DataFrame, by: list[str], at: str, counter: str, span: float) -> DataFrame:
    """``by, peak``: highest rate of a rising counter over the shortest stretch of at least ``span``.

    The start of a stretch is the last sample at least ``span`` before its end.
    """
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(Window.unboundedPreceding, -span)
    start = F.max(F.struct(F.col(at).alias("t"), F.col(counter).alias("c"))).over(w)
    rate = samples.select(*by, ((F.col(counter) - start["c"]) / (F.col(at) - start["t"])).alias("rate"))
    return rate.groupBy(*by).agg(F.max("rate").alias("peak"))


def kmeans_step(points: DataFrame, centres: np.ndarray, features: str = "features") -> DataFrame:
    """``cluster, n, centre``: one Lloyd step; ties go to the lower cluster."""
    d = [F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    label = F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1
    each = points.select(label.alias("cluster"), F.posexplode(features).alias("i", "v"))
    mean = each.groupBy("cluster", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return mean.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centre"))


def number_evidence(rows: DataFrame, key: list[str], order: str, tau: float = 4.0, ratio: float = 0.6) -> DataFrame:
    """``key, number, since``: first moment at which a number's summed evidence commits.

    ``rows``: key, order, p (probabilities: an array with one for each number, or a map of those
    that are not 0), pnone.  Evidence is never negative and ``tau`` is above 0, so a number commits
    only at a moment that adds to it: entries of 0 are left out before the one shuffle by key, and
    its own sum and the sum of all are running sums over the other entries.
    """
    entries = F.posexplode("p") if rows.schema["p"].dataType.typeName() == "array" else F.explode("p")
    long = rows.select(*key, order, entries.alias("number", "_p"), (1 - F.col("pnone")).alias("_w")).withColumn("_e", F.col("_p") * F.col("_w")).where("_e > 0").drop("_p", "_w")
    every, one = Window.partitionBy(*key).orderBy(order), Window.partitionBy(*key, "number").orderBy(order)
    sums = long.repartition(*key).withColumn("_t", F.sum("_e").over(every)).withColumn("_s", F.sum("_e").over(one))
    ready = sums.where((F.col("_s") >= tau) & (F.col("_s") >= ratio * F.col("_t")))
    first = F.min(F.struct(F.col(order).alias("o"), (-F.col("_s")).alias("s"), F.col("number").alias("n")))
    return ready.groupBy(*key).agg(first.alias("_f")).select(*key, F.col("_f.n").alias("number"), F.col("_f.o").alias("since"))
