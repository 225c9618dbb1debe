"""Error mining from alignments: classes of errors, confusions, garbled runs, words, versions."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.functions import align
from escriba.functions.text import SPACE, for_error_analysis

# Letters that the period writes for each other, and letters that look alike in the hand.
ALTERNATIONS = "uv ij xj sſ bv".split()
MODERNIZED = (("q", "c"),)
VISUAL = "eo ao ae nu nr mn ce tr do li lt fs hb db".split()
#: Characters in error, one after another, that make a garbled run.
GARBLED = 20


def _accents() -> tuple[str, str]:
    """Accented letters and what is left of each without its accent, from the Unicode decompositions of the Latin blocks."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char:
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()


def without_accents(text: Column) -> Column:
    """Letters without accents."""
    return F.translate(text, _MARKED, _PLAIN)


def _either(a: Column, b: Column, pairs: list[str]) -> Column:
    both = [p for x in pairs for p in (x, x[::-1])]
    return F.concat(a, b).isin(*both)


def substitution_class(ref: Column, hyp: Column) -> Column:
    """The class of a substituted character; of several that fit the first."""
    r, h = F.lower(ref), F.lower(hyp)
    r_base, h_base = without_accents(r), without_accents(h)
    mark = r"^[^\p{L}\p{N}]"
    modern = F.lit(False)
    for a, b in MODERNIZED:
        modern = modern | ((r == a) & (h == b))
    return (
        F.when(r == h, "case")
        .when((r_base == h_base) & (r_base != ""), "diacritical")
        .when((r.isin("ç") | h.isin("ç")) & (r_base.isin("c", "z") | h_base.isin("c", "z")), "cedilla")
        .when(_either(r, h, ALTERNATIONS), "paleographic_alternation")
        .when(modern, "modernization")
        .when((r == "&") | (h == "&"), "abbreviation_marker")
        .when(r.rlike(f"^{SPACE}") | h.rlike(f"^{SPACE}"), "word_boundary")
        .when(r.rlike(mark) | h.rlike(mark), "punctuation")
        .when(_either(r, h, VISUAL), "visual_confusion")
        .otherwise("other_substitution")
    )


def deletion_class(text: Column) -> Column:
    """What was left out: white space, an abbreviation sign, or text."""
    return F.when(text.rlike(f"^{SPACE}+$"), "deleted_whitespace").when(text.rlike("^&+$"), "deleted_abbreviation").otherwise("deleted_text")


def insertion_class(text: Column) -> Column:
    """What was put in: white space or text."""
    return F.when(text.rlike(f"^{SPACE}+$"), "inserted_whitespace").otherwise("inserted_text")


def spans(pairs: DataFrame, keys: list[str], words: bool = False) -> DataFrame:
    """One row per operation: (keys, place, tag, ref_span, hyp_span, size). Texts are normalized for error analysis first.

    Of words, spans are joined by single spaces and sizes count words. What agrees has a size but no text, which no one asks for.
    """
    kinds = dict(pairs.dtypes)
    names = [*keys, "place", "tag", "ref_span", "hyp_span", "size"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        glue = " " if words else ""
        for batch in batches:
            out = []
            rows = zip(batch["ref"], batch["hyp"], *[batch[k] for k in keys], strict=True)
            for ref, hyp, *own in rows:
                a, b = (ref.split(), hyp.split()) if words else (ref, hyp)
                for place, (tag, i, j, k, m) in enumerate(align.operations(a, b)):
                    equal = tag == "equal"
                    out.append((*own, place, tag, "" if equal else glue.join(a[i:j]), "" if equal else glue.join(b[k:m]), max(j - i, m - k)))
            yield pd.DataFrame(out, columns=names)

    rows = pairs.where("ref IS NOT NULL AND hyp IS NOT NULL").select(*keys, for_error_analysis(F.col("ref")).alias("ref"), for_error_analysis(F.col("hyp")).alias("hyp"))
    return rows.mapInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", place int, tag string, ref_span string, hyp_span string, size int")


def counted_spans(pairs: DataFrame, by: list[str], words: bool = False) -> DataFrame:
    """(by, tag, ref_span, hyp_span, n): spans in error, counted batch by batch before anything leaves Python."""
    kinds = dict(pairs.dtypes)
    names = [*by, "tag", "ref_span", "hyp_span", "n"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        glue = " " if words else ""
        for batch in batches:
            found: Counter[tuple] = Counter()
            for ref, hyp, *own in zip(batch["ref"], batch["hyp"], *[batch[k] for k in by], strict=True):
                a, b = (ref.split(), hyp.split()) if words else (ref, hyp)
                for tag, i, j, k, m in align.operations(a, b):
                    if tag != "equal":
                        found[*own, tag, glue.join(a[i:j]), glue.join(b[k:m])] += 1
            yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=names)

    rows = pairs.where("ref IS NOT NULL AND hyp IS NOT NULL").select(*by, for_error_analysis(F.col("ref")).alias("ref"), for_error_analysis(F.col("hyp")).alias("hyp"))
    counted = rows.mapInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in by) + ", tag string, ref_span string, hyp_span string, n bigint")
    return counted.groupBy(*by, "tag", "ref_span", "hyp_span").agg(F.sum("n").alias("n"))


def confusions(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, ref_char, hyp_char, class, n) of substituted characters, from counted spans."""
    pairs = counted.where("tag = 'replace'").select(*by, "n", F.explode(F.arrays_zip(F.split("ref_span", "").alias("r"), F.split("hyp_span", "").alias("h"))).alias("p"))
    chars = pairs.where("p.r <> '' AND p.h <> ''").groupBy(*by, F.col("p.r").alias("ref_char"), F.col("p.h").alias("hyp_char")).agg(F.sum("n").alias("n"))
    return chars.withColumn("class", substitution_class(F.col("ref_char"), F.col("hyp_char")))


def error_classes(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, n): substitutions by character, deletions and insertions by span, from counted spans."""
    chars = F.arrays_zip(F.split("ref_span", "").alias("r"), F.split("hyp_span", "").alias("h"))
    parts = F.when(F.col("tag") == "replace", chars).otherwise(F.array(F.struct(F.col("ref_span").alias("r"), F.col("hyp_span").alias("h"))))
    pairs = counted.select(*by, "tag", "n", F.explode(parts).alias("p")).where("tag <> 'replace' OR (p.r <> '' AND p.h <> '')")
    summed = pairs.groupBy(*by, "tag", "p.r", "p.h").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("tag") == "replace", substitution_class(F.col("r"), F.col("h"))).when(F.col("tag") == "delete", deletion_class(F.col("r"))).otherwise(insertion_class(F.col("h")))
    return summed.groupBy(*by, kind.alias("class")).agg(F.sum("n").alias("n"))


def garbled_runs(rows: DataFrame, keys: list[str], least: int = GARBLED) -> DataFrame:
    """Runs of at least so many characters in error that end in agreement; runs at a page's end are not reported.

    Islands are numbered by the agreements before them.
    """
    order = Window.partitionBy(*keys).orderBy("place")
    equal = F.col("tag") == "equal"
    island = rows.withColumn("island", F.sum(F.when(equal, 1).otherwise(0)).over(order)).withColumn("last", F.max("place").over(Window.partitionBy(*keys)))
    runs = island.where(~equal).groupBy(*keys, "island").agg(F.sum("size").alias("errors"), F.max("place").alias("end"), F.max("last").alias("last"), F.sum(F.length("ref_span")).alias("length"))
    return runs.where((F.col("errors") >= least) & (F.col("end") < F.col("last"))).select(*keys, "island", "errors", "length")


def word_errors(counted: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """E5: (by, tag, ref_word, hyp_word, n) of words replaced, left out and put in, from counted spans of words."""
    zipped = F.arrays_zip(F.split("ref_span", " ").alias("r"), F.split("hyp_span", " ").alias("h"))
    pairs = counted.select(*by, "tag", "n", F.explode(zipped).alias("p"))
    blank = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c))
    summed = pairs.groupBy(*by, "tag", blank("p.r").alias("ref_word"), blank("p.h").alias("hyp_word")).agg(F.sum("n").alias("n"))
    if top is None:
        return summed
    order = Window.partitionBy(*by, "tag").orderBy(F.desc("n"), "ref_word", "hyp_word")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def version_report(classes: DataFrame, totals: DataFrame, version: str = "model") -> DataFrame:
    """Per version and class of error its count, its share of the version's errors and its rate over the characters of the reference,
    and how far that rate is from the mean of the versions."""
    own = classes.groupBy(version).agg(F.sum("n").alias("errors"))
    rows = classes.join(own, version).join(totals, version).withColumn("rate", F.col("n") / F.col("gt_chars")).withColumn("share", F.col("n") / F.col("errors"))
    mean = rows.groupBy("class").agg(F.avg("rate").alias("mean_rate"))
    out = rows.join(F.broadcast(mean), "class")  # as many rows as there are classes
    return out.select(version, "class", "n", "share", "rate", ((F.col("rate") - F.col("mean_rate")) / F.col("mean_rate")).alias("deviation"))


def persistent_confusions(confused: DataFrame, version: str = "model", top: int = 30) -> DataFrame:
    """Confusions that every version shows, with their counts over all, the most frequent first."""
    versions = confused.select(version).distinct().agg(F.count("*").alias("versions"))
    pairs = confused.groupBy("ref_char", "hyp_char").agg(F.countDistinct(version).alias("shown_by"), F.sum("n").alias("n"))
    kept = pairs.join(F.broadcast(versions), pairs.shown_by == versions.versions).select("ref_char", "hyp_char", "n")
    return kept.orderBy(F.desc("n"), "ref_char", "hyp_char").limit(top)


def line_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per text the lines kept, replaced, left out and put in, as runs of lines of both sides; of replaced lines also the words,
    with their tags, in the order of the lines."""

    def words(a: list[str], b: list[str]) -> list[dict]:
        left, right = " ".join(a).split(), " ".join(b).split()
        found = difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
        return [{"tag": tag, "ref": " ".join(left[i:j]), "hyp": " ".join(right[k:m])} for tag, i, j, k, m in found]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ref, hyp, *own in zip(batch["ref"], batch["hyp"], *[batch[k] for k in keys], strict=True):
                a, b = ref.split("\n"), hyp.split("\n")
                for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    out.append((*own, tag, "\n".join(a[i:j]), "\n".join(b[k:m]), words(a[i:j], b[k:m]) if tag == "replace" else []))
            yield pd.DataFrame(out, columns=[*keys, "tag", "ref_lines", "hyp_lines", "words"])

    kinds = dict(pairs.dtypes)
    rows = pairs.where("ref IS NOT NULL AND hyp IS NOT NULL").select(*keys, "ref", "hyp")
    return rows.mapInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tag string, ref_lines string, hyp_lines string, words array<struct<tag: string, ref: string, hyp: string>>")
