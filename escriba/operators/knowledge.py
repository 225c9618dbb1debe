"""Tables of knowledge for prompts: abbreviations and spellings of the period, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def abbreviation_table(entries: DataFrame) -> DataFrame:
    """One row, the abbreviations with their expansions as a JSON object in the order of the alphabet. The list is a fixed one."""
    listed = F.array_sort(F.collect_list(F.struct("abbreviated", "expanded")))
    return entries.agg(F.to_json(F.map_from_entries(listed)).alias("table"))


def alternation_lines(features: DataFrame, examples: int = 3) -> DataFrame:
    """(feature, line) per spelling of the period: how often it occurs, and its first examples."""
    line = F.concat(F.lit("- "), F.col("feature"), F.lit(": "), F.col("n").cast("string"), F.lit(" occurrences — "), F.array_join(F.slice("examples", 1, examples), ", "))
    return features.select("feature", line.alias("line"))


def combined_abbreviations(entries: DataFrame, groups: DataFrame, examples: int = 5) -> DataFrame:
    """(abbreviated, source, expanded, examples, n): the list's entries, and the expansions mined from texts that it lacks."""
    known = entries.select("abbreviated", F.lit("academic").alias("source"), "expanded", F.array().cast("array<string>").alias("examples"), F.lit(None).cast("long").alias("n"))
    mined = groups.join(entries.select("abbreviated"), groups.expansion == F.col("abbreviated"), "left_anti")
    mined = mined.select(F.col("expansion").alias("abbreviated"), F.lit("empirical").alias("source"), F.col("expansion").alias("expanded"), F.slice("examples", 1, examples).alias("examples"), F.col("n").cast("long").alias("n"))
    return known.unionByName(mined)
