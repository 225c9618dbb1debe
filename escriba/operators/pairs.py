"""Joining ground truth and hypotheses by page, spread so that one page may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A page with more than this share of the hypotheses is split; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.005
#: Parts that a split page has at most.
MOST_SALTS = 256


def with_values(rows: DataFrame, *columns: str) -> DataFrame:
    """The given columns of the rows that have none of them null."""
    rows = rows.select(*columns)
    for column in columns:
        rows = rows.where(F.col(column).isNotNull())
    return rows


def distinct_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """The same without repeated rows."""
    return with_values(rows, *columns).distinct()


#: Rows of a table to compare that one task takes, and how few are still worth a task of their own where cores would idle.
TASK_ROWS, FEW_ROWS = 50_000, 500


def tasks_for(rows: DataFrame) -> int:
    """Tasks for the comparisons of a table's rows. What is done with a pair costs far more than its bytes suggest, so the number follows the
    rows: a count, which a column store answers from its footers."""
    n = rows.count()
    return max(1, -(-n // TASK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FEW_ROWS)))


def by_page(left: DataFrame, right: DataFrame, key: str = "page_id", source: DataFrame | None = None) -> DataFrame:
    """Inner join of two tables on a key whose frequent values on the right are split into parts.

    The rows of the left with such a key are repeated once per part, all others once. Columns other than the key must differ. ``source`` is the
    table that the right comes from, whose keys are cheaper to count, and whose rows tell the number of tasks; without it, both sides are shuffled on
    the join's own keys and adaptive execution joins small partitions and splits large ones.
    """
    counts = (right if source is None else source).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = (
        counts.crossJoin(F.broadcast(total))  # one row
        .where(F.col("n") > F.greatest(F.col("total") * HOT_SHARE, F.lit(1000.0)))
        .select(key, F.least(F.lit(MOST_SALTS), F.ceil(F.col("n") / (F.col("total") * HOT_SHARE))).cast("int").alias("parts"))
    )
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    others = [c for c in right.columns if c != key]
    place = F.pmod(F.xxhash64(*others), F.col("parts")).cast("int")
    spread = right.join(hot, key, "left").withColumn("part", F.coalesce(place, F.lit(0))).drop("parts")
    repeated = left.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    if source is not None:
        tasks = tasks_for(source)
        repeated, spread = repeated.repartition(tasks, key, "part"), spread.repartition(tasks, key, "part")
    return repeated.hint("merge").join(spread, [key, "part"]).drop("part")


def busy(rows: DataFrame) -> DataFrame:
    """Rows in as many partitions as the cluster has cores, if a small input has fewer; a large one is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def page_dimension(manifest: DataFrame) -> DataFrame:
    """One row per page: the first catalogued of those that repeat it."""
    first = manifest.where("page_id IS NOT NULL").groupBy("page_id")
    names = ["dataset", "doc_id", "siglo", "letra_normalized", "copista", "tipologia"]
    return first.agg(F.min_by(F.struct(*names), "man_id").alias("row")).select("page_id", *[F.col(f"row.{n}").alias(n) for n in names])
