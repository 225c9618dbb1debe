"""Text normalization as chains of column expressions; Python is used for composing Unicode alone.

White space is what Python's ``str.split`` takes for it, not the narrower ``\\s`` of Java.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Character class of white space, and the same without the line feed.
SPACE = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"
SPACE_BUT_LF = r"[\p{Z}\x09\x0b-\x0d\x1c-\x1f\x85]"
NOT_SPACE = r"[^\p{Z}\x09-\x0d\x1c-\x1f\x85]"

ColumnFn = Callable[[Column], Column]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space, line ends included, become one space; none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Characters that can change when a text is composed: beyond Latin-1 and the extended Latin letters.
_MAY_COMPOSE = r"[^\x00-˿‐-‧‰-⁞]"


def nfc(text: Column) -> Column:
    """Composed Unicode. Only texts with characters that composing can change are sent to Python."""
    odd = text.rlike(_MAY_COMPOSE)
    return F.when(odd, _compose(F.when(odd, text))).otherwise(text)


def tier1(text: Column) -> Column:
    """Composed, soft hyphens gone, tabs as spaces, single spaces."""
    text = F.regexp_replace(F.translate(nfc(text), "­", ""), "\t", " ")
    return strip(F.regexp_replace(text, " {2,}", " "))


def tier2(text: Column) -> Column:
    """Tier 1 without any white space."""
    return F.regexp_replace(tier1(text), SPACE, "")


def casefold(text: Column) -> Column:
    """Lower case with sharp s as two letters."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def tier3(text: Column) -> Column:
    """Tier 2 in one case."""
    return casefold(tier2(text))


def tier4(text: Column) -> Column:
    """Tier 3 with letters, numbers and marks alone."""
    return F.regexp_replace(tier3(text), r"[^\p{L}\p{N}\p{M}]", "")


#: The tiers by name, from raw to letters alone.
TIERS: dict[str, ColumnFn] = {"T1_raw": tier1, "T2_nospace": tier2, "T3_lowercase": tier3, "T4_alnum": tier4}

# Markers of the transcriptions that hold text, and those that hold none.
TEXT_MARKERS = ("firma", "tachado", "margen", "interlineado", "sobrescrito", "encabezamiento", "nota", "mano[^:]*")
EMPTY_MARKERS = ("signo", "rúbrica", "cruz", "ilegible", "blanco", "roto")
#: Per mode, the markers whose text stays, and what stands for a blank left in the original.
MARKER_MODES = {
    "content": ({"interlineado", "sobrescrito", "encabezamiento", "firma", "mano[^:]*"}, " "),
    "lenient": ({"interlineado", "sobrescrito", "encabezamiento"}, ""),
}


def _alternatives(names) -> str:
    return "|".join(names)


def strip_markers(text: Column, mode: str = "content") -> Column:
    """Markers of the transcription as the mode wants them.

    ``strict`` leaves the text alone. ``content`` keeps the text of readable markers, ``lenient`` that of insertions and headings only.
    The markers are taken in the listed order, so that nested ones always come out alike.
    """
    if mode == "strict":
        return text
    kept, blank = MARKER_MODES[mode]
    for name in TEXT_MARKERS:
        text = F.regexp_replace(text, rf"(?ius)\[{name}{SPACE}*:{SPACE}*(.*?)\]", "$1" if name in kept else "")
    text = F.regexp_replace(text, r"(?iu)\[blanco\]", blank)
    text = F.regexp_replace(text, rf"(?iu)\[(?:{_alternatives(m for m in EMPTY_MARKERS if m != 'blanco')})\]", "")
    text = F.regexp_replace(text, r"\[([a-záéíóúñç]{1,5})\]", "$1")
    return strip(F.regexp_replace(F.regexp_replace(text, "  +", " "), r" *\n *", "\n"))


def strip_markers_keep_text(text: Column) -> Column:
    """The text of every marker stays; names in lower case only; markers do not run over lines."""
    for name in TEXT_MARKERS:
        text = F.regexp_replace(text, rf"\[{name}:{SPACE}*(.*?)\]", "$1")
    text = F.regexp_replace(text, r"\[blanco\]", " ")
    return F.regexp_replace(text, rf"\[(?:{_alternatives(m for m in EMPTY_MARKERS if m != 'blanco')})\]", "")


def for_error_analysis(text: Column) -> Column:
    """N7b, composed, white space collapsed."""
    return collapse_whitespace(nfc(strip_markers_keep_text(text)))


# The longer marker lists of the review variant, and the names that let a marker keep its text.
REVIEW_TEXT_MARKERS = (
    "tachado", "raspado", "sobre raspado", "sobrescrito", "interlineado", "firma", "margen", r"mano \d+", "encabezamiento", "título", r"lat\.", "nota",
)
REVIEW_EMPTY_MARKERS = ("rúbrica", "cruz", "signo", "sello", "crismón", "blanco", "roto", "doblez", "mancha", "ilegible", "quirógrafo")
REVIEW_KEPT = ("firma", "interlineado", "sobrescrito", "encabezamiento", "mano")


def strip_markers_review(text: Column) -> Column:
    """The review variant; a marker keeps its text if its name holds one of the kept names."""
    for name in REVIEW_TEXT_MARKERS:
        text = F.regexp_replace(text, rf"(?ius)\[{name}{SPACE}*:{SPACE}*(.*?)\]", "$1" if any(k in name for k in REVIEW_KEPT) else "")
    text = F.regexp_replace(text, r"(?iu)\[blanco\]", " ")
    text = F.regexp_replace(text, rf"(?iu)\[(?:{_alternatives(m for m in REVIEW_EMPTY_MARKERS if m != 'blanco')})\]", "")
    return F.regexp_replace(text, r"\[([a-záéíóúñç]{1,5})\]", "$1")


def for_resolution_experiment(text: Column) -> Column:
    """Composed, N7c, N1."""
    return collapse_whitespace(strip_markers_review(nfc(text)))


def evaluation_text(text: Column, mode: str = "content") -> Column:
    """What both sides of a comparison go through: markers by mode, then white space collapsed."""
    return collapse_whitespace(strip_markers(text, mode))


def marker_aliases(text: Column) -> Column:
    """Spellings of markers brought to those of the ground truth."""
    for pattern, name in (
        (r"(?iu)\[rubrica\]", "[rúbrica]"),
        (rf"(?iu)\[firmas{SPACE}*:", "[firma:"),
        (r"(?iu)\[ill?egible\]", "[ilegible]"),
        (r"\[\.\.\.\]", "[ilegible]"),
        (r"(?iu)\[blank\]", "[blanco]"),
    ):
        text = F.regexp_replace(text, pattern, name)
    return text


# What models put around a transcription, in the order in which it goes.
BOILERPLATE = (
    (r"(?m)^#+" + SPACE + r"+.*$", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"```[^`]*```", ""),
    (rf"(?iu)\A(?:here is|the following is|below is|this is).*?transcription.*?:{SPACE}*\n", ""),
    (rf"(?iu)\A(?:transcription|transcribed text|output):{SPACE}*\n", ""),
    (r"(?iuU)\A(?:i can see|the image shows|the manuscript).*?\n(?=\w)", ""),
    (r"(?ius)\n(?:note:|notes?:|\*note).*\z", ""),
    (r"(?ius)\n(?:the text appears|this appears to be|this document).*\z", ""),
    (r"(?ius)\n(?:---+).*\z", ""),
)


def strip_boilerplate(text: Column) -> Column:
    """Headings, emphasis, fenced blocks with their content, opening and closing remarks of a model."""
    for pattern, by in BOILERPLATE:
        text = F.regexp_replace(text, pattern, by)
    return text


def drop_metadata_header(text: Column) -> Column:
    """What stands above the line "Latin", if the first line is "Spanish" and "Latin" is among lines 3 to 10."""
    lines = F.split(text, "\n", -1)
    trimmed = F.transform(lines, strip)
    place = F.array_position(F.slice(trimmed, 3, 8), F.lit("Latin"))
    rest = F.array_join(F.slice(lines, place.cast("int") + 3, F.greatest(F.size(lines), F.lit(1))), "\n")
    return F.when((F.element_at(trimmed, 1) == "Spanish") & (place > 0), rest).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Without XML or HTML tags."""
    return F.regexp_replace(text, "<[^>]+>", "")


#: What is done first for a model, by the last part of its name.
PREPROCESSORS: dict[str, ColumnFn] = {"churro_3b": drop_metadata_header}


def register_preprocessor(model: str, fn: ColumnFn) -> None:
    """What is to be done first with a model's texts, under the last part of its name; a name can't be taken twice."""
    _register(PREPROCESSORS, model, fn)


def register_tier(name: str, fn: ColumnFn) -> None:
    """One more tier for the tier metrics; a name can't be taken twice."""
    _register(TIERS, name, fn)


def _register(registry: dict[str, ColumnFn], name: str, fn: ColumnFn) -> None:
    if not name or not callable(fn):
        raise ValueError("a name and a function of a column are needed")
    if name in registry:
        raise ValueError(f"{name} is registered already")
    registry[name] = fn


def preprocess(text: Column, model: Column | None = None) -> Column:
    """The preprocessor registered for the model, then tags stripped."""
    if model is not None:
        name = F.element_at(F.split(model, "/"), -1)
        for key, fn in PREPROCESSORS.items():
            text = F.when(name == key, fn(text)).otherwise(text)
    return strip_tags(text)


def straight_signs(text: Column) -> Column:
    """Dashes as hyphens, straight quotes, zero-width characters gone."""
    return F.translate(text, "–—“”‘’​‌‍﻿", "--\"\"''")


def normalize_model_output(text: Column, model: Column | None = None) -> Column:
    """Raw output of a model as text that can be compared."""
    text = marker_aliases(straight_signs(nfc(strip_boilerplate(preprocess(text, model)))))
    text = F.regexp_replace(text, f"{SPACE_BUT_LF}+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return strip(text)


def normalize_unicode(text: Column) -> Column:
    """The part of N6 that also ground truth goes through."""
    text = F.regexp_replace(straight_signs(nfc(text)), f"{SPACE_BUT_LF}+", " ")
    return strip(F.regexp_replace(text, r" *\n *", "\n"))


def escape_html(text: Column) -> Column:
    """The four signs that HTML reserves."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


# Forms of one and of two letters that a vocabulary keeps.
ONE_LETTER_FORMS = "a e o y i u".split()
TWO_LETTER_FORMS = "al de el en es la le lo me mi no ni os se si su te tu un ya yo do ha he ir".split()


def clean_form(word: Column) -> Column:
    """A word form fit for a vocabulary, or null for several words, signs alone, digits, quotes and rare short forms."""
    form = F.replace(F.lower(strip(word)), F.lit("="), F.lit(""))
    form = strip(F.regexp_replace(form, r"&#[0-9]+;", ""))
    bad = form.contains(" ") | (form == "") | form.rlike(r'["$]') | form.rlike("^[-.,;:!?¿¡–—()\\[\\]{}«»\"'/\\\\|_=+$&@#]*$")
    form = F.replace(form, F.lit("&amp;"), F.lit("&"))
    bad = bad | form.rlike("^[0-9.,/:;ªº]+$") | form.rlike("[0-9¹²³⁰-⁹]")
    short = ((F.length(form) == 1) & ~form.isin(*ONE_LETTER_FORMS)) | ((F.length(form) == 2) & ~form.isin(*TWO_LETTER_FORMS))
    return F.when(~bad & ~short, form)


def normalize_letra(letra: Column) -> Column:
    """script types in broad groups; what belongs to none stays, in lower case."""
    low = strip(F.lower(letra))
    return (
        F.when(low.contains("encadenada"), "procesal encadenada")
        .when((low == "procesal") | low.startswith("procesal/"), "procesal")
        .when(low.rlike("cortesan[ao]"), "cortesana/procesal")
        .when(low.contains("humanística"), "humanística/procesal")
        .otherwise(low)
    )


def normalize_siglo(siglo: Column) -> Column:
    """century as XV, XVI or XVII; from a year if it starts with one; else unknown."""
    year = F.substring(siglo, 1, 4).try_cast("int")
    return (
        F.when(siglo.isin("XV", "XVI", "XVII"), siglo)
        .when(year < 1500, "XV")
        .when(year < 1600, "XVI")
        .when(year.isNotNull(), "XVII")
        .otherwise("unknown")
    )


def letra_in_text(text: Column) -> Column:
    """the script named in running text after the word "letra", or null."""
    found = F.regexp_extract(text, r"(?U)[Ll]etra\s+([\w\s\-/]+?)(?:\.|,|\n)", 1)
    return F.when(found != "", F.lower(strip(found)))
