"""Metrics of a reference against a hypothesis as column expressions; lengths and distances count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from escriba.functions.align import edit_distance, word_edit_distance
from escriba.functions.text import NOT_SPACE, SPACE, TIERS

def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def cer(ref: Column, hyp: Column) -> Column:
    """M1: edit distance over the reference's length, unbounded; an empty reference gives 1 against any text, else 0."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) > 0, 1.0).otherwise(0.0)).otherwise(_ratio(edit_distance(ref, hyp), F.length(ref)))


def cer_or_zero(ref: Column, hyp: Column) -> Column:
    """The same, but 0 for an empty reference."""
    return F.when(F.length(ref) == 0, 0.0).otherwise(_ratio(edit_distance(ref, hyp), F.length(ref)))


def nls(ref: Column, hyp: Column) -> Column:
    """M3: 1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(ref), F.length(hyp))
    return F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - _ratio(edit_distance(ref, hyp), longest))


def words(text: Column) -> Column:
    """The words between white space, as an array without empty ones."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def wer(ref: Column, hyp: Column) -> Column:
    """M4: edit distance in words over the words of the reference; a blank reference gives 1 against any word, else 0."""
    blank = ~ref.rlike(NOT_SPACE)
    return F.when(blank, F.when(hyp.rlike(NOT_SPACE), 1.0).otherwise(0.0)).otherwise(_ratio(word_edit_distance(ref, hyp), F.size(words(ref))))


def line_errors(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """(lines that differ place by place, lines of the longer text); an empty text has no line, a missing line counts as empty."""
    a = F.when(ref == "", F.array().cast("array<string>")).otherwise(F.split(ref, "\n", -1))
    b = F.when(hyp == "", F.array().cast("array<string>")).otherwise(F.split(hyp, "\n", -1))
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    wrong = F.size(F.filter(pairs, lambda p: F.coalesce(p["a"], F.lit("")) != F.coalesce(p["b"], F.lit(""))))
    return wrong, F.greatest(F.size(a), F.size(b))


def ser(ref: Column, hyp: Column) -> Column:
    """M5: share of lines that differ; an empty reference gives 1 against any line, else 0."""
    wrong, lines = line_errors(ref, hyp)
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(_ratio(wrong, lines))


def boc_difference(ref: Column, hyp: Column) -> Column:
    """Characters by which the two bags of characters differ: both lengths less twice what they share.

    What they share is counted per different character of the reference, so the cost is its alphabet times its length.
    """

    def count(text: Column, char: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, char, F.lit("")))

    alphabet = F.array_distinct(F.split(ref, "", -1))
    shared = F.aggregate(
        F.filter(alphabet, lambda c: c != ""), F.lit(0), lambda total, c: total + F.least(count(ref, c), count(hyp, c))
    )
    return F.length(ref) + F.length(hyp) - shared * 2


def boc(ref: Column, hyp: Column) -> Column:
    """M9: that difference over the longer length. Texts that share nothing give up to 2."""
    longest = F.greatest(F.length(ref), F.length(hyp))
    return F.when(longest == 0, 0.0).otherwise(_ratio(boc_difference(ref, hyp), longest))


def delta_cer(cer_value: Column, boc_value: Column) -> Column:
    """What the order of characters adds to the error."""
    return cer_value - boc_value


def tier_error_rates(ref: Column, hyp: Column) -> dict[str, Column]:
    """M8: edit distance at each tier over the length of the reference at the first tier."""
    first = F.length(TIERS["T1_raw"](ref))
    out = {}
    for name, tier in TIERS.items():
        a, b = tier(ref), tier(hyp)
        empty = F.when(F.length(TIERS["T1_raw"](hyp)) > 0, 1.0).otherwise(0.0)
        out[name] = F.when(first == 0, empty).otherwise(_ratio(edit_distance(a, b), first))
    return out


def precision_recall(s: Column, d: Column, i: Column, c: Column) -> dict[str, Column]:
    """M7 from the counts of operations: precision, recall, F1, and the rates over the reference's length (1 at least)."""
    zero = F.lit(0.0)
    precision = F.when(c + s + i > 0, _ratio(c, c + s + i)).otherwise(zero)
    recall = F.when(c + s + d > 0, _ratio(c, c + s + d)).otherwise(zero)
    n = F.greatest(c + s + d, F.lit(1))
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(zero),
        "s_rate": _ratio(s, n),
        "d_rate": _ratio(d, n),
        "i_rate": _ratio(i, n),
    }


def cer_n(s: Column, d: Column, i: Column, c: Column) -> Column:
    """M2: errors over errors and agreements; 0 for two empty texts."""
    total = s + d + i + c
    return F.when(total == 0, 0.0).otherwise(_ratio(s + d + i, total))


def score(ref: Column, hyp: Column) -> Column:
    """1 less the error rate, 0 at least; an empty reference gives 1 against an empty text, else 0."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - cer(ref, hyp)))


# Least score of each band and what is said there.
FEEDBACK = (
    (0.8, "Good transcription, minor errors."),
    (0.5, "Moderate errors — check abbreviation expansion, character forms (u/v, i/y, ç/z), and spelling modernization (preserve original orthography)."),
    (0.0, "High error rate — likely misreading letterforms or hallucinating content not on the page. Transcribe only what is visible."),
)


def feedback(score_value: Column) -> Column:
    """The error rate in percent and what is said of it."""
    said = F.lit(FEEDBACK[-1][1])
    for least, text in reversed(FEEDBACK[:-1]):
        said = F.when(score_value >= least, F.lit(text)).otherwise(said)
    return F.concat(F.lit("CER "), F.format_string("%.0f", (F.lit(1.0) - score_value) * 100), F.lit("%. "), said)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)

    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)
