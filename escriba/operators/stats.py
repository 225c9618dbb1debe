"""Resampling and rank tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs up to which the exact distribution of the signed-rank statistic is counted, if no ranks are tied.
EXACT_UP_TO = 50


def bootstrap(values: np.ndarray, resamples: int = 10_000, level: float = 0.95, seed: int = 42, statistic: str = "mean") -> tuple[float, float, float]:
    """(point, low, high) by the percentile method; the generator is drawn as one block, block by block of rows."""
    if not len(values):
        return 0.0, 0.0, 0.0
    fn = np.mean if statistic == "mean" else np.median
    rng = np.random.default_rng(seed)
    drawn = np.empty(resamples)
    step = max(1, 2_000_000 // len(values))
    for start in range(0, resamples, step):
        size = min(step, resamples - start)
        drawn[start : start + size] = fn(rng.choice(values, size=(size, len(values)), replace=True), axis=1)
    tail = (1 - level) / 2 * 100
    return float(fn(values)), float(np.percentile(drawn, tail)), float(np.percentile(drawn, 100 - tail))


#: Pages of a model that one task resamples.
SLICE_ROWS = 100_000


def _sums(values: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Per resample the sum of so many values drawn with replacement."""
    out = np.empty(len(draws))
    step = max(1, 2_000_000 // max(1, len(values)))
    for start in range(0, len(draws), step):
        some = draws[start : start + step]
        if (some == len(values)).all():
            out[start : start + step] = rng.choice(values, size=(len(some), len(values)), replace=True).sum(axis=1)
        else:
            ends = np.cumsum(some)
            running = np.concatenate([[0.0], np.cumsum(values[rng.integers(0, len(values), int(ends[-1]))])])
            out[start : start + step] = running[ends] - running[ends - some]
    return out


def bootstrap_intervals(rows: DataFrame, value: str = "cer", resamples: int = 10_000, level: float = 0.95, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """T1 of the mean per model: (model, n, point, low, high).

    A model's pages are split into slices of about ``slice_rows`` by a hash. How many of a resample's draws fall in each slice is one multinomial
    draw per resample, which every task makes alike from the seed; each slice gives the sums of its draws, and sums are added up per model. With one
    slice, values in the order of pages, this is the plain percentile bootstrap.
    """
    rows = rows.where(F.col(value).isNotNull()).select("model", F.coalesce("page_id", F.lit("")).alias("page_id"), F.col(value).cast("double").alias("v"))
    parts = rows.groupBy("model").agg(F.count("*").alias("n")).select("model", "n", F.ceil(F.col("n") / slice_rows).cast("int").alias("parts"))
    cut = rows.join(F.broadcast(parts), "model").withColumn("part", F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("int"))  # one row a model
    sizes = cut.groupBy("model", "part").agg(F.count("*").alias("size")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("part", "size"))).alias("sizes"))
    cut = cut.join(F.broadcast(sizes), "model")  # one row a model, as many sizes as slices

    def one(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        values = group.sort_values(["page_id", "v"], kind="stable")["v"].to_numpy()
        shares = np.array([s["size"] for s in first["sizes"]], dtype=float)
        at = [s["part"] for s in first["sizes"]].index(first["part"])
        if len(shares) == 1:
            draws, rng = np.full(resamples, len(values)), np.random.default_rng(seed)
        else:
            draws = np.random.default_rng([seed, 1]).multinomial(int(first["n"]), shares / shares.sum(), size=resamples)[:, at]
            rng = np.random.default_rng([seed, 2, at])
        return pd.DataFrame({"model": [first["model"]], "size": [len(values)], "total": [values.sum()], "sums": [_sums(values, draws, rng)]})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["size"].sum())
        means = np.sum(np.stack(group.sort_values("size", kind="stable")["sums"].to_list()), axis=0) / n
        tail = (1 - level) / 2 * 100
        return pd.DataFrame([(group["model"].iloc[0], n, group["total"].sum() / n, np.percentile(means, tail), np.percentile(means, 100 - tail))], columns=["model", "n", "point", "low", "high"])

    sums = cut.groupBy("model", "part").applyInPandas(one, "model string, size long, total double, sums array<double>")
    return sums.groupBy("model").applyInPandas(together, "model string, n long, point double, low double, high double")


def signed_rank_statistic(pairs: DataFrame) -> DataFrame:
    """Per two models the smaller signed-rank sum W, and what its distribution depends on.

    Differences of 0 are left out. Average ranks come from counts per absolute difference, so that tied pages
    are never ranked one by one.
    """
    keys = ["model_a", "model_b"]
    diff = pairs.select(*keys, (F.col("value_a") - F.col("value_b")).alias("d")).where("d <> 0")
    sizes = diff.groupBy(*keys, F.abs("d").alias("size")).agg(
        F.count("*").alias("t"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("plus"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("minus")
    )
    before = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    return ranked.groupBy(*keys).agg(
        F.sum("t").alias("n"),
        F.least(F.sum(F.col("rank") * F.col("plus")), F.sum(F.col("rank") * F.col("minus"))).alias("w"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
        F.max("t").alias("most_tied"),
    )


def signed_rank_p(n: int, w: float, ties: int, tied: bool) -> float:
    """Two-sided p: exact by counting subsets of ranks if few and untied, else the normal approximation with tie correction."""
    if n < 2:
        return 1.0
    if n <= EXACT_UP_TO and not tied:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for total in range(len(ways) - 1, rank - 1, -1):
                ways[total] += ways[total - rank]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean = n * (n + 1) / 4
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - mean) / spread / math.sqrt(2)) if spread else 1.0


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Statistic and p of every two models; 0 and 1 where fewer than two pages differ."""
    keys = pairs.select("model_a", "model_b").distinct()

    @F.pandas_udf("double")
    def p_of(n: pd.Series, w: pd.Series, ties: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(a), float(b), int(c), int(d) > 1) for a, b, c, d in zip(n, w, ties, most, strict=True)])

    stat = signed_rank_statistic(pairs)
    stat = stat.select("model_a", "model_b", "n", "w", p_of("n", "w", "ties", "most_tied").alias("p"))
    enough = F.col("n") >= 2
    return keys.join(stat, ["model_a", "model_b"], "left").select(
        "model_a",
        "model_b",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.when(enough, F.col("w")).otherwise(0.0).alias("statistic"),
        F.when(enough, F.col("p")).otherwise(1.0).alias("p_value"),
    )


def holm(tests: DataFrame, p: str = "p_value", order: tuple[str, ...] = ("model_a", "model_b"), alpha: float = 0.05) -> DataFrame:
    """Holm's step-down correction over all rows; ties keep the given order.

    The tests of a family number as the pairs of models, so that their order may come from one task.
    """
    ordered = Window.orderBy(p, *order)
    rows = tests.withColumn("place", F.row_number().over(ordered)).withColumn("family", F.count("*").over(Window.partitionBy()))
    step = F.col(p) * (F.col("family") - F.col("place") + 1)
    running = F.max(step).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("p_adjusted", F.least(running, F.lit(1.0))).withColumn("significant", F.col("p_adjusted") < alpha).drop("place", "family")


def pairwise_significance(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """T4: Wilcoxon tests of all pairs, p rounded to six places, then corrected together."""
    return holm(wilcoxon(pairs).withColumn("p_value", F.round("p_value", 6)))


def enough_to_compare(rows: DataFrame, common: DataFrame, models: int = 2, pages: int = 5) -> DataFrame:
    """T5: one row, whether there are enough models and common pages."""
    return rows.agg(F.countDistinct("model").alias("models")).crossJoin(common.agg(F.count("*").alias("pages"))).withColumn(
        "enough", (F.col("models") >= models) & (F.col("pages") >= pages)
    )
