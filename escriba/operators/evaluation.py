"""Evaluation: metrics per compared pair, aggregates per model and stratum, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.functions import align, metrics
from escriba.functions.text import TIERS, evaluation_text, strip
from escriba.operators.pairs import busy, by_page, page_dimension, with_values

# Editions that a subset has, and pages that are never compared.
EDITIONS = {"codea": ("paleographic", "critical"), "toledo": ("editorial",)}
EXCLUDED_PAGES = ("codea_CODEA-3623_1r", "codea_CODEA-3623_3r", "codea_CODEA-3623_6r", "codea_CODEA-2027_1v")


def valid_editions(rows: DataFrame) -> DataFrame:
    """rows whose edition belongs to their subset."""
    fits = F.lit(False)
    for subset, editions in EDITIONS.items():
        fits = fits | ((F.col("subset") == subset) & F.col("edition").isin(*editions))
    return rows.where(fits)


def exclude_pages(rows: DataFrame, excluded: DataFrame | None = None, pages: tuple[str, ...] = EXCLUDED_PAGES) -> DataFrame:
    """Without excluded pages, from a list or a table."""
    if excluded is not None:
        rows = rows.join(excluded.select("page_id"), "page_id", "left_anti")
    return rows.where(~F.col("page_id").isin(*pages)) if pages else rows


def texts_to_compare(gt: DataFrame, hypotheses: DataFrame, mode: str = "content") -> tuple[DataFrame, DataFrame]:
    """Both sides of J1: (subset, edition, page_id, ref) and (model, page_id, hyp), each text normalized once, repeated rows as one."""
    refs = exclude_pages(with_values(busy(valid_editions(gt)), "subset", "edition", "page_id", "gt_text"))
    hyps = with_values(busy(hypotheses), "model", "page_id", "hyp_text")
    refs = refs.select("subset", "edition", "page_id", evaluation_text(strip(F.col("gt_text")), mode).alias("ref")).distinct()
    return refs, hyps.select("model", "page_id", evaluation_text(strip(F.col("hyp_text")), mode).alias("hyp")).distinct()


def compared(gt: DataFrame, hypotheses: DataFrame, mode: str = "content") -> DataFrame:
    """Every (subset, edition, page_id, model, ref, hyp), texts normalized for the mode.

    Normalizing goes before the join, once per text; repeated runs and editions count once. Rows without a text or page are left out.
    """
    return by_page(*texts_to_compare(gt, hypotheses, mode), source=hypotheses)


KEYS = ["subset", "edition", "page_id", "model"]


def core_metrics(pairs: DataFrame) -> DataFrame:
    """M1, M3, M4, M5 and the lengths of each pair; everything stays in the JVM, and each distance is computed once."""
    ref, hyp = F.col("ref"), F.col("hyp")
    rows = pairs.withColumn("distance", align.edit_distance(ref, hyp)).withColumn("gt_chars", F.length(ref)).withColumn("hyp_chars", F.length(hyp))
    longest = F.greatest("gt_chars", "hyp_chars")
    empty = F.when(F.col("hyp_chars") > 0, 1.0).otherwise(0.0)
    return rows.select(
        *KEYS,
        F.when(F.col("gt_chars") == 0, empty).otherwise(F.col("distance") / F.col("gt_chars")).alias("cer"),
        F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.col("distance") / longest).alias("nls"),
        metrics.wer(ref, hyp).alias("wer"),
        metrics.ser(ref, hyp).alias("ser"),
        "distance",
        "gt_chars",
        "hyp_chars",
    )


def tier_metrics(gt: DataFrame, hypotheses: DataFrame, mode: str = "content") -> DataFrame:
    """M8 of each pair. The tiers of a text are made once, before it meets the texts it is compared with."""
    refs, hyps = texts_to_compare(gt, hypotheses, mode)
    for name, tier in TIERS.items():
        refs = refs.withColumn(f"ref_{name}", tier(F.col("ref")))
        hyps = hyps.withColumn(f"hyp_{name}", tier(F.col("hyp")))
    pairs = by_page(refs.drop("ref"), hyps.drop("hyp"), source=hypotheses)
    first = F.length("ref_T1_raw")
    empty = F.when(F.length("hyp_T1_raw") > 0, 1.0).otherwise(0.0)
    rates = [F.when(first == 0, empty).otherwise(align.edit_distance(F.col(f"ref_{n}"), F.col(f"hyp_{n}")) / first).alias(n) for n in TIERS]
    return pairs.select(*KEYS, *rates)


def tier_lengths(pairs: DataFrame) -> DataFrame:
    """Lengths of both sides at each tier."""
    out = []
    for name, tier in TIERS.items():
        out += [F.length(tier(F.col("ref"))).alias(f"{name}_ref"), F.length(tier(F.col("hyp"))).alias(f"{name}_hyp")]
    return pairs.select(*KEYS, *out)


def order_metrics(pairs: DataFrame) -> DataFrame:
    """M9 and M10 of each pair."""
    ref, hyp = F.col("ref"), F.col("hyp")
    out = pairs.select(*KEYS, metrics.boc(ref, hyp).alias("boc"), metrics.cer(ref, hyp).alias("cer"))
    return out.withColumn("delta_cer", metrics.delta_cer(F.col("cer"), F.col("boc")))


def decomposition(pairs: DataFrame) -> DataFrame:
    """M2, M6 and M7 of each pair, from one alignment."""
    counted = pairs.withColumn("ops", align.operation_counts(F.col("ref"), F.col("hyp")))
    s, d, i, c = (F.col(f"ops.{n}") for n in align.COUNTS.names)
    named = metrics.precision_recall(s, d, i, c)
    return counted.select(*KEYS, "ops.*", metrics.cer_n(s, d, i, c).alias("cer_n"), *[v.alias(k) for k, v in named.items()])


def page_metrics(gt: DataFrame, hypotheses: DataFrame, mode: str = "content") -> DataFrame:
    """All metrics of each pair as nested structs, as reports hold them (K1)."""
    pairs = compared(gt, hypotheses, mode)
    ref, hyp = F.col("ref"), F.col("hyp")
    rows = pairs.withColumn("ops", align.operation_counts(ref, hyp))
    s, d, i, c = (F.col(f"ops.{n}") for n in align.COUNTS.names)
    tiers = metrics.tier_error_rates(ref, hyp)
    rows = rows.withColumn("cer", metrics.cer(ref, hyp)).withColumn("boc", metrics.boc(ref, hyp))
    split = metrics.precision_recall(s, d, i, c)
    return rows.select(
        *KEYS,
        "cer",
        F.struct(F.col("cer"), metrics.cer_n(s, d, i, c).alias("cer_n"), metrics.nls(ref, hyp).alias("nls"), metrics.wer(ref, hyp).alias("wer"), metrics.ser(ref, hyp).alias("ser")).alias("core"),
        F.struct(*[v.alias(k) for k, v in tiers.items()]).alias("romein"),
        F.struct(*[v.alias(k) for k, v in split.items()], "ops.*").alias("decomposition"),
        F.struct("boc", (F.col("cer") - F.col("boc")).alias("delta_cer")).alias("order_independent"),
    )


def metric_means(gt: DataFrame, hypotheses: DataFrame, mode: str = "content") -> DataFrame:
    """Per model the means of all metrics: core, tiers, precision and recall, rates of operations, order."""
    pairs = compared(gt, hypotheses, mode).withColumn("distance", align.edit_distance(F.col("ref"), F.col("hyp")))
    ref, hyp = F.col("ref"), F.col("hyp")
    ops = decomposition(pairs.select(*KEYS, "ref", "hyp"))
    longest = F.greatest(F.length(ref), F.length(hyp))
    rate = F.when(F.length(ref) == 0, F.when(F.length(hyp) > 0, 1.0).otherwise(0.0)).otherwise(F.col("distance") / F.length(ref))
    rows = pairs.select("model", rate.alias("cer"), F.when(longest == 0, 1.0).otherwise(1 - F.col("distance") / longest).alias("nls"), metrics.ser(ref, hyp).alias("ser"), metrics.boc(ref, hyp).alias("boc"))
    rows = rows.withColumn("delta_cer", F.round("cer", 6) - F.col("boc"))
    means = lambda df, names: df.groupBy("model").agg(*[F.avg(n).alias(n) for n in names])
    out = means(rows, ["cer", "nls", "ser", "boc", "delta_cer"])
    out = out.join(means(ops, ["cer_n", "precision", "recall", "f1", "s_rate", "d_rate", "i_rate"]), "model")
    return out.join(means(tier_metrics(gt, hypotheses, mode), list(TIERS)), "model")  # one row a model on all sides


def model_summary(rows: DataFrame, value: str = "cer", by: tuple[str, ...] = ("model",)) -> DataFrame:
    """A1: count, mean, median, spread and range of a metric per group; the spread of one row is 0."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_pages"),
        F.avg(v).alias(f"{value}_mean"),
        F.median(v).alias(f"{value}_median"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{value}_stdev"),
        F.min(v).alias(f"{value}_min"),
        F.max(v).alias(f"{value}_max"),
    )


def ranking(summary: DataFrame, value: str = "cer_mean") -> DataFrame:
    """Models by mean rounded to four places, ties by name, each with a rank of its own.

    A summary has one row per model, so that its order may come from one task.
    """
    order = Window.orderBy(F.round(value, 4), "model")
    return summary.withColumn("rank", F.row_number().over(order))


def stratified(rows: DataFrame, pages: DataFrame, value: str = "cer", strata: tuple[str, ...] = ("siglo", "letra_normalized")) -> DataFrame:
    """A3: means per model and stratum, all strata in one pass by grouping sets; blank strata are left out."""
    joined = rows.join(pages.select("page_id", *strata), "page_id")
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).alias("level")) for s in strata]))
    long = joined.select("model", value, named.alias("s")).select("model", value, "s.*")
    return long.where("level IS NOT NULL AND trim(level) <> ''").groupBy("model", "stratum", "level").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def pivoted(rows: DataFrame, pages: DataFrame, stratum: str, levels: list[str], value: str = "cer", fill: float | None = None) -> DataFrame:
    """One row per model, one column per level of a stratum."""
    joined = rows.join(pages.select("page_id", stratum), "page_id").where(F.col(stratum).isin(*levels))
    wide = joined.groupBy("model").pivot(stratum, levels).agg(F.avg(value))
    return wide.fillna(fill) if fill is not None else wide


def common_pages(rows: DataFrame) -> DataFrame:
    """Pages that every model has."""
    models = rows.select("model").distinct().agg(F.count("*").alias("models"))
    per_page = rows.groupBy("page_id").agg(F.countDistinct("model").alias("n"))
    return per_page.join(F.broadcast(models), per_page.n == models.models).select("page_id")


def model_pairs(rows: DataFrame, value: str = "cer") -> DataFrame:
    """Per page the values of every two models, the smaller name first. Rows must be one per page and model.

    The pairs of a page come from the sorted list of its models, which is as long as there are models.
    """
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("model", F.col(value).alias("v")))).alias("m"))
    a = listed.select("page_id", "m", F.posexplode("m").alias("i", "a"))
    b = a.select("page_id", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return b.select("page_id", F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("a.v").alias("value_a"), F.col("b.v").alias("value_b"))


def per_page_and_model(rows: DataFrame, value: str = "cer", places: int = 6) -> DataFrame:
    """One value per page and model: the mean over editions and runs, rounded as reports hold it."""
    return rows.groupBy("page_id", "model").agg(F.round(F.avg(value), places).alias(value))


#: How far a group's rate may be from the mean before it is flagged.
FLAGGED_BEYOND = 0.15


def micro_average(rows: DataFrame, errors: Column, total: Column, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Sums over sums per group, how far that is from the mean of the groups, and whether it is too far."""
    rates = rows.groupBy(*by).agg(F.sum(errors).alias("errors"), F.sum(total).alias("total")).withColumn("rate", F.col("errors") / F.col("total"))
    mean = rates.agg(F.avg("rate").alias("mean"))
    apart = rates.crossJoin(F.broadcast(mean)).withColumn("deviation", (F.col("rate") - F.col("mean")) / F.col("mean")).drop("mean")  # one row
    return apart.withColumn("flagged", F.abs("deviation") > FLAGGED_BEYOND)


def mode_comparison(gt: DataFrame, hypotheses: DataFrame, modes: tuple[str, ...] = ("strict", "content", "lenient")) -> DataFrame:
    """A4: mean error rate per model and way of treating markers.

    Equal texts count once in each mode. Texts of all modes meet in one join; a pair that is alike in several modes is aligned once.
    """
    refs = valid_editions(gt).select("subset", "edition", "page_id", "gt_text")
    refs = exclude_pages(with_values(busy(refs), "subset", "edition", "page_id", "gt_text"))
    hyps = with_values(busy(hypotheses), "model", "page_id", "hyp_text")

    def in_modes(rows: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
        texts = F.array(*[F.struct(F.lit(m).alias("mode"), evaluation_text(strip(F.col(text)), m).alias("t")) for m in modes])
        long = rows.select(*keys, F.explode(texts).alias("m"))
        return long.groupBy(*keys, F.col("m.t").alias(name)).agg(F.collect_set("m.mode").alias(f"{name}_modes"))

    joined = by_page(in_modes(refs, ["subset", "edition", "page_id"], "gt_text", "ref"), in_modes(hyps, ["model", "page_id"], "hyp_text", "hyp"), source=hypotheses)
    shared = joined.withColumn("modes", F.array_intersect("ref_modes", "hyp_modes")).where(F.size("modes") > 0)
    rated = shared.select("model", "modes", metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"))
    return rated.select(F.explode("modes").alias("mode"), "model", "cer").groupBy("mode", "model").agg(F.avg("cer").alias("cer_mean"))


def core_rate(pairs: DataFrame) -> DataFrame:
    """The error rate alone."""
    return pairs.select(*KEYS, metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"))


def with_pages(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Left join of the page dimension."""
    return rows.join(page_dimension(manifest), "page_id", "left")
