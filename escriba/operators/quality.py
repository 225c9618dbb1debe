"""Constraint checks, resuming, and reshaping of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that every document has, and what the ground truth may be.
CORE_FIELDS = ("doc_id", "dataset", "date", "title", "archive", "letra", "facsimile_pages", "ground_truth")
GROUND_TRUTH_TYPES = ("paleographic+critical", "normalized", None)
GROUND_TRUTH_FORMATS = ("per-page-txt", "single-document-md", None)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """F8: (key, rule) of every row that breaks a rule, all rules in one pass; a rule is what must hold, null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def metadata_rules(fields: dict[str, Column], available: Column, kind: Column, form: Column, listed: Column, found: Column) -> dict[str, Column]:
    """F8: what must hold of a document's metadata: core fields are there, the ground truth is of a known kind, and listed pages are those found."""
    rules = {f"metadata missing {name}": column.isNotNull() for name, column in fields.items()}
    rules["ground_truth missing available"] = available.isNotNull()
    rules["invalid ground_truth.type"] = kind.isNull() | kind.isin(*[k for k in GROUND_TRUTH_TYPES if k])
    rules["invalid ground_truth.format"] = form.isNull() | form.isin(*[f for f in GROUND_TRUTH_FORMATS if f])
    rules["facsimile_pages mismatch"] = same_set(F.coalesce(listed, F.array().cast("array<string>")), found)
    return rules


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, as often."""
    return F.array_sort(a) == F.array_sort(b)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K8: rows without an output yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def procesal(rows: DataFrame, column: str = "letra") -> DataFrame:
    """rows whose script is a court hand."""
    return rows.where(F.lower(column).rlike("procesal|procesada"))


def with_facsimile_count(metadata: DataFrame, counted: DataFrame) -> DataFrame:
    """The number of pages put into the metadata, what is there kept where nothing was counted."""
    joined = metadata.join(counted.select("doc_id", F.col("facsimile_count").alias("counted")), "doc_id", "left")
    if "facsimile_count" not in metadata.columns:
        return joined.withColumnRenamed("counted", "facsimile_count")
    return joined.withColumn("facsimile_count", F.coalesce("counted", "facsimile_count")).drop("counted")


def reshaped(rows: DataFrame, core: dict[str, Column], available: Column, kind: Column, form: Column, extra: list[str]) -> DataFrame:
    """core fields, a nested ground_truth, and the other fields, where they hold something, as a map."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra]))
    kept = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    truth = F.struct(available.alias("available"), kind.alias("type"), form.alias("format"))
    return rows.select(*[c.alias(name) for name, c in core.items()], truth.alias("ground_truth"), kept.alias("extra"))


def paths(rows: DataFrame) -> DataFrame:
    """identifiers and paths of catalogued pages, by dataset."""
    name = F.concat_ws("_", "dataset", "doc_id", "page")
    base = F.concat(F.lit("data/corpora/"), F.col("dataset"), F.lit("/documents/"), F.col("doc_id"))
    target = lambda edition: F.concat(F.lit("data/subsets/"), F.col("dataset"), F.lit(f"/ground_truth/{edition}/"), name, F.lit(".txt"))
    editions = F.when(
        F.col("dataset") == "codea", F.map_from_arrays(F.array(F.lit("paleographic"), F.lit("critical")), F.array(target("paleographic"), target("critical")))
    ).otherwise(F.map_from_arrays(F.array(F.lit("editorial")), F.array(target("editorial"))))
    return rows.select(
        "*", name.alias("page_key"), F.concat(base, F.lit("/facsimiles/"), F.col("page"), F.lit(".jpg")).alias("image"), F.concat(name, F.lit(".jpg")).alias("canonical"), editions.alias("texts")
    )
