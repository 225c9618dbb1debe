"""Evaluation of hypotheses as they come in: the same normalization and metrics over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from escriba.functions import metrics
from escriba.functions.text import evaluation_text, strip
from escriba.operators.evaluation import exclude_pages, valid_editions


def scored_stream(hypotheses: DataFrame, gt: DataFrame, mode: str = "content", late: str = "2 days") -> DataFrame:
    """Each new hypothesis against every edition of its page: (run_at, model, page_id, subset, edition, cer).

    Repeated runs within the time that rows may be late count once; the ground truth is a table, joined as it is at the start.
    """
    refs = exclude_pages(valid_editions(gt).where("gt_text IS NOT NULL AND page_id IS NOT NULL")).select("subset", "edition", "page_id", evaluation_text(strip(F.col("gt_text")), mode).alias("ref")).distinct()
    hyps = hypotheses.where("hyp_text IS NOT NULL AND page_id IS NOT NULL").withWatermark("run_at", late)
    hyps = hyps.dropDuplicatesWithinWatermark(["model", "page_id", "hyp_text"])
    hyps = hyps.select("run_at", "model", "page_id", evaluation_text(strip(F.col("hyp_text")), mode).alias("hyp"))
    joined = hyps.join(refs, "page_id")
    return joined.select("run_at", "model", "page_id", "subset", "edition", metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"))


def windowed_rates(scored: DataFrame, width: str = "7 days") -> DataFrame:
    """Count and mean of the error rate per model and window of time; a window is given out once no row can come late for it."""
    return scored.groupBy(F.window("run_at", width), "model").agg(F.count("*").alias("n"), F.avg("cer").alias("cer_mean"))


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there so far to Parquet and stop; a later call goes on from the checkpoint (K8)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
