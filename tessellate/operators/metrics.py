"""Retrieval metrics, summaries and bootstrap intervals.  Undefined values are NULL."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shipped
from .retrieve import UNIT

CUTOFFS = (1, 3, 5)
RESAMPLES, ALPHA = 2000, 0.05


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    wanted = F.array_distinct(gold)
    return F.try_divide(F.size(F.array_intersect(wanted, F.slice(ranked, 1, k))), F.size(wanted))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    return F.coalesce(F.try_divide(F.lit(1.0), F.array_min(places)), F.lit(0.0))


def retrieval_rows(cases: DataFrame, ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Of cases (with gold_ids and ranked) that have gold: recall_k and rr columns."""
    if not ks or min(ks) < 1:
        raise ValueError("cutoffs must be positive and at least one")
    out = cases.where(F.size("gold_ids") > 0)
    for k in ks:
        out = out.withColumn(f"recall_{k}", recall_at(F.col("ranked"), F.col("gold_ids"), k))
    return out.withColumn("rr", reciprocal_rank(F.col("ranked"), F.col("gold_ids")))


def retrieval_summary(rows: DataFrame, ks: tuple[int, ...] = CUTOFFS, *by: str) -> DataFrame:
    means = [F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *means, F.avg("rr").alias("mrr"))


# Fixed: the order of draws and the places of the bounds, as intervals must agree to the last bit.
def _interval(values: list[float], n: int, alpha: float, seed: int) -> tuple[float, float]:
    rng = random.Random(seed)
    means = sorted(sum(rng.choice(values) for _ in values) / len(values) for _ in range(n))
    return means[int(alpha / 2 * n)], means[int((1 - alpha / 2) * n) - 1]


def bootstrap_exact(rows: DataFrame, value: str, order: str, *by: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the mean with Python's own generator over values in order: the
    published intervals.  Meant for evaluation sets, whose size is a few thousand at most;
    bootstrap() scales."""
    shipped(rows.sparkSession)
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.col(order).cast("long").alias("ord_"), F.col(value).cast("double").alias("value_"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = _interval(pdf.sort_values("ord_")["value_"].tolist(), n, alpha, seed)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "lo": [lo], "hi": [hi]})

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), "lo double", "hi double"])
    return kept.groupBy(*by).applyInPandas(run, schema)


def bootstrap(rows: DataFrame, value: str, order: str, *by: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """The same interval by a portable integer hash, in built-in functions: resample r takes at
    place p the value numbered pmod(r * 1103515245 + p * 12345 + seed, size).

    Rows are gathered as one array for each group, which is bounded by the evaluation set.  The
    draws are a line through the places, so where the size is prime to 12345 each resample takes
    every value once and the interval is a point: a fixed check of the arithmetic.  For intervals
    of large sets use bootstrap_merged()."""
    kept = rows.where(F.col(value).isNotNull())
    lists = kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("xs"))
    size = F.size("xs").cast("long")
    place = lambda p: F.pmod(F.col("r") * F.lit(1103515245) + p * F.lit(12345) + F.lit(seed), size)
    total = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda p: F.get("xs", place(p).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    means = lists.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select(*by, (total / size).alias("m"))
    order_ = F.array_sort(F.collect_list("m"))
    return means.groupBy(*by).agg(order_.alias("ms")).select(*by, F.get("ms", F.lit(int(alpha / 2 * n))).alias("lo"), F.get("ms", F.lit(int((1 - alpha / 2) * n) - 1)).alias("hi"))


# Bounds of the shares of Poisson(1), of 2^31 - 1: how often a value is drawn.
PRIME = (1 << 31) - 1
POISSON = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(8))


def drawn(key: Column, r: Column, seed: int = 0) -> Column:
    """How often resample r takes the value of a row with that key (a whole number): 0 to 8, with
    the chances of Poisson(1), by a portable hash."""
    mixed = F.pmod(F.pmod(key, F.lit(PRIME)) * F.lit(48_271) + r * F.lit(69_621) + F.lit(seed + 1), F.lit(PRIME))
    mixed = F.pmod(mixed * mixed + r, F.lit(PRIME))
    mixed = F.pmod(mixed * F.lit(16_807) + key, F.lit(PRIME))
    u = F.pmod(mixed * mixed + F.lit(seed), F.lit(PRIME))
    return sum((F.when(u >= bound, 1).otherwise(0) for bound in POISSON), F.lit(0))


def bootstrap_sums(rows: DataFrame, value: str, key: str, *by: str, n: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(by, r, total, draws) of each of n resamples: sums over rows, so those of parts of the rows
    add up to those of the whole.  Values are summed in whole numbers of 2^-40."""
    kept = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    each = kept.select(*by, F.col(value).cast("double").alias("v"), F.col(key).cast("long").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("r"))
    times = each.select(*by, "v", "r", drawn(F.col("k"), F.col("r"), seed).cast("long").alias("w"))
    return times.groupBy(*by, "r").agg(F.sum(F.rint(F.col("v") * UNIT).cast("long") * F.col("w")).alias("total"), F.sum("w").alias("draws"))


def bootstrap_merged(rows: DataFrame, value: str, key: str, *by: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the mean where each row is drawn a Poisson number of times, by its
    key: no row has to know of another, so partitions sum their own and only n sums of each
    group are moved.  Its interval agrees with the others' within sampling error."""
    sums = bootstrap_sums(rows, value, key, *by, n=n, seed=seed)
    means = sums.where("draws > 0").select(*by, "r", (F.col("total") / UNIT / F.col("draws")).alias("m"))
    order = Window.partitionBy(*by).orderBy("m", "r")  # n rows of a group
    placed = means.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    at = lambda share, less: F.max(F.when(F.col("i") == F.greatest(F.floor(F.lit(share) * F.col("n")) + 1 - less, F.lit(1)), F.col("m")))
    return placed.groupBy(*by).agg(at(alpha / 2, 0).alias("lo"), at(1 - alpha / 2, 1).alias("hi"))


def confusion(rows: DataFrame, *by: str, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision and recall (NULL of nothing)."""
    e, p = F.col(expected), F.col(predicted)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    rate = lambda a, b: F.try_divide(a, b)
    return counts.select("*", rate(F.expr("tp + tn"), F.col("n")).alias("accuracy"), rate(F.col("tp"), F.expr("tp + fp")).alias("precision"), rate(F.col("tp"), F.expr("tp + fn")).alias("recall"))
