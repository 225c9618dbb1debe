"""Entities of two texts matched one to one (J4), and what comes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escriba.functions.align import counts

#: Similarity above which two entities are one.
THRESHOLD = 0.7


def _similar(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - sum(counts(a, b)[:3]) / longest if longest else 0.0


def match(ref: list[tuple[str, str]], hyp: list[tuple[str, str]], threshold: float = THRESHOLD) -> int:
    """How many (text, label) of the reference find one of their label, the most similar that is left; the first of equals."""
    left = list(enumerate(hyp))
    matched = 0
    for text, label in ref:
        scored = [(_similar(text.lower(), t.lower()), -i) for i, (t, kind) in left if kind == label]
        if scored and max(scored)[0] > threshold:
            taken = -max(scored)[1]
            left = [(i, e) for i, e in left if i != taken]
            matched += 1
    return matched


def entity_metrics(rows: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """M12 of rows with arrays ``ref_entities`` and ``hyp_entities`` of (text, label): precision, recall, F1 and counts; 1 where neither has any."""
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                ref = [(e["text"], e["label"]) for e in row["ref_entities"]]
                hyp = [(e["text"], e["label"]) for e in row["hyp_entities"]]
                n = match(ref, hyp, threshold)
                if not ref and not hyp:
                    p = r = f = 1.0
                else:
                    p, r = n / len(hyp) if hyp else 0.0, n / len(ref) if ref else 0.0
                    f = 2 * p * r / (p + r) if p + r else 0.0
                out.append((*[row[k] for k in keys], p, r, f, len(ref), len(hyp), n))
            yield pd.DataFrame(out, columns=[*keys, "ner_precision", "ner_recall", "ner_f1", "ref_entities", "hyp_entities", "matched_entities"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema += ", ner_precision double, ner_recall double, ner_f1 double, ref_entities int, hyp_entities int, matched_entities int"
    return rows.select(*keys, "ref_entities", "hyp_entities").mapInPandas(work, schema)


#: Functions from picture to text by name, for runs that are configured by names.
PIPELINES: dict[str, Callable[[bytes], str]] = {}


def register_pipeline(name: str, transcribe: Callable[[bytes], str]) -> None:
    """A function from picture to text under a name; a name can't be taken twice."""
    if not name or name in PIPELINES:
        raise ValueError(f"{name!r} is empty or registered already")
    PIPELINES[name] = transcribe


def transcriptions_by(images: DataFrame, names: list[str], content: str = "content") -> DataFrame:
    """(pipeline, path, text, error) of each named pipeline over the pictures."""
    unknown = [n for n in names if n not in PIPELINES]
    if unknown or not names:
        raise ValueError(f"unknown pipelines: {unknown}" if unknown else "no pipeline is named")
    out = None
    for name in names:
        one = with_transcriptions(images, PIPELINES[name], content).withColumn("pipeline", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("pipeline", "path", "text", "error")


def with_transcriptions(images: DataFrame, transcribe: Callable[[bytes], str], content: str = "content") -> DataFrame:
    """Interface of model inference: a function from picture to text, run per batch; an error becomes a value, not a failed task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for picture in batch[content]:
                try:
                    texts.append(transcribe(bytes(picture)))
                    errors.append(None)
                except Exception as error:  # whatever the model raises
                    texts.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"path": list(batch["path"]), "text": texts, "error": errors})

    return images.select("path", content).mapInPandas(work, "path string, text string, error string")


def cosine_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """M11 of the vectors that two tables have for one key."""
    from escriba.functions.metrics import cosine

    joined = a.select(key, F.col("embedding").alias("left")).join(b.select(key, F.col("embedding").alias("right")), key)
    return joined.select(key, cosine(F.col("left"), F.col("right")).alias("cosine"))
