"""Editions of the ground truth: from the transcribers' formats to one text per page."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escriba.functions.text import SPACE, normalize_unicode, strip

#: Signs that no text holds, to mark places while a text is taken apart.
_CUT, _END, _KEEP = "\x01", "\x02", "\x00"
# How folio and cover markers are written, and what is known of single documents.
FOLIO = r"(?iu)\[\s*_?(?:Fol\.?|Folio)\s+(\d+)\s*,?\s*(recto|vuelto|vuelta|r|v)_?\s*\]"
COVER = r"(?iu)\[\s*_?Cubierta_?\s*\]"
KNOWN_OFFSETS = {"046_1535-09-24-1539-05-28": 4, "073_1617-01-16-1617-08-26": 2}
LINE_DOCUMENTS = ("046_1535-09-24-1539-05-28",)
#: Characters that a page has at least, markers aside, to count as transcribed.
LEAST_CHARS = 50


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Replacements one after another."""
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


# How editorial wrappers of a line are rewritten, in this order.
EDITION_RULES = (
    (r"(?iu)\s+mano\s+\d+\s*:\s*", ": "),
    (r"(?iu)\[mano\s+\d+\s*:\s*", ""),
    (r"(?iu)\[firmas\s*:", "[firma:"),
    (r"(?iu)\[rubrica\]", "[rúbrica]"),
    (r"(?iu)\(tachado\s+(.*?)\)", "[tachado: $1]"),
    (r"(?iu)\[lat\.\s*:(.*?)\]", "$1"),
    (r"(?iu)\[blanco\s+[^\]]+\]", "[blanco]"),
    (r"\[\*[\s*]*\*\]", "[ilegible]"),
    (r"\*{3,}", "[ilegible]"),
    (r"[≤|]", ""),
    (r"\s*/\s*\z", ""),
)


def clean_edition_line(line: Column) -> Column:
    """One manuscript line with editorial wrappers gone and markers in one form."""
    line = chain(line, *EDITION_RULES)
    closes = F.length(line) - F.length(F.translate(line, "]", ""))
    opens = F.length(line) - F.length(F.translate(line, "[", ""))
    line = F.when(closes > opens, F.regexp_replace(line, r"\](?=\s*\z)", "")).otherwise(line)
    return F.regexp_replace(line, "  +", " ")


def parse_edition(text: Column) -> Column:
    """Page headers dropped, what stands between bare line numbers joined to a line, each line cleaned, blank ones dropped.

    Line numbers become cuts and all other line ends go, so that one split gives the manuscript lines.
    """
    text = chain(text, (r"(?m)^\{h\.\s*\w+\}.*$", ""), (rf"(?m){SPACE}+$", ""), (r"(?m)^\s*\d+$", _CUT), (r"\n", ""))
    lines = F.transform(F.split(text, _CUT), lambda line: strip(clean_edition_line(line)))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def without_front_matter(text: Column) -> Column:
    """A leading block between lines of three hyphens is dropped."""
    return F.when(text.startswith("---"), strip(F.regexp_replace(text, r"(?s)\A---.*?---", ""))).otherwise(text)


def _parts(text: Column) -> Column:
    """What stands before the first folio marker, then "folio|side" and what follows, per marker."""
    return F.split(F.regexp_replace(text, FOLIO, f"{_CUT}$1|$2{_END}"), _CUT)


def _number(part: Column) -> Column:
    """Page number of a part: two to a folio, recto first."""
    folio = F.substring_index(part, "|", 1).try_cast("int")
    side = F.lower(F.substring_index(F.substring_index(part, _END, 1), "|", -1))
    return (folio - 1) * 2 + F.when(side.isin("recto", "r"), 1).otherwise(2)


def folio_page(text: Column, page: Column) -> Column:
    """Text of a page by its number: what comes before the first marker is page 1, then from marker to marker."""
    parts = _parts(text)
    found = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: _number(p) == page)
    body = F.substring_index(F.try_element_at(found, F.lit(1)), _END, -1)
    return F.when(page == 1, F.element_at(parts, 1)).otherwise(F.coalesce(body, F.lit("")))


def folio_pages(documents: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """Every page of every document: (key, page_no, page_text); of a page that comes twice the first."""
    parts = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(_parts(without_front_matter(F.col(text)))).alias("i", "part"))
    rows = parts.select(
        key,
        "i",
        F.when(F.col("i") == 0, 1).otherwise(_number(F.col("part"))).alias("page_no"),
        F.when(F.col("i") == 0, F.col("part")).otherwise(F.substring_index("part", _END, -1)).alias("page_text"),
    )
    return rows.groupBy(key, "page_no").agg(F.min_by("page_text", "i").alias("page_text"))


def page_offset(text: Column, doc: Column | None = None) -> Column:
    """Images before the first folio: known ones, else 1 for a cover marker or a title of some length before the first folio."""
    first = F.element_at(_parts(text), 1)
    markers = F.size(_parts(text)) > 1
    number = _number(F.try_element_at(_parts(text), F.lit(2)))
    covered = first.rlike(COVER)
    titled = (F.length(first) > 100) & (F.length(strip(first)) > LEAST_CHARS)
    out = F.when(markers & covered, 1).when(markers & (number == 2), 0).when(markers & titled, 1).otherwise(0)
    if doc is not None:
        for name, offset in KNOWN_OFFSETS.items():
            out = F.when(doc == name, offset).otherwise(out)
    return out


def last_image(text: Column, doc: Column | None = None) -> Column:
    """Number of the last image with text of a transcription: the highest page of its folio markers and the images before them, at least 1."""
    body = without_front_matter(text)
    parts = _parts(body)
    pages = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _number)
    return F.greatest(F.lit(1), F.array_max(pages)) + F.coalesce(page_offset(body, doc), F.lit(0))


def is_transcribed(page_text: Column) -> Column:
    """whether a page has text enough, bracketed marks aside."""
    plain = F.regexp_replace(F.regexp_replace(page_text, r"\[.*?\]", ""), f"{SPACE}+", " ")
    return F.length(strip(plain)) >= LEAST_CHARS


def marker(name: str, text: Column) -> Column:
    """N15: "[name: text]" without line breaks in it; nothing for no text."""
    inner = strip(F.regexp_replace(F.translate(text, "/", " "), f"{SPACE}+", " "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(f"[{name}: "), inner, F.lit("]")))


FOOTNOTE = T.ArrayType(T.StructType([T.StructField("ref", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("page", T.IntegerType())]))
_FOLIO_RE = re.compile(FOLIO.replace("(?iu)", ""), re.I)


class Notes:
    """Footnotes of a document and the pages of their references."""

    START = re.compile(r"^(\d+)\s+([A-ZÁÉÍÓÚ].*)")

    @classmethod
    def take(cls, text: str) -> tuple[list[tuple[int, str, int]], str]:
        """(number, content, place) of each note, and the text without them. A note goes on in lines that start lower case."""
        notes: list[tuple[int, str, int]] = []
        rest: list[str] = []
        place, going = 0, False
        for raw in text.split("\n"):
            line = raw.strip()
            begins = cls.START.match(line) if len(line) > 30 else None
            if begins:
                notes.append((int(begins[1]), begins[2], place))
                going = True
            elif going and line[:1].islower():
                number, content, at = notes[-1]
                notes[-1] = (number, f"{content} {line}", at)
                going = not line.endswith((".", "。"))
            else:
                rest.append(raw)
                going = False
            place += len(raw) + 1
        return notes, "\n".join(rest)

    @staticmethod
    def pages(text: str, notes: list[tuple[int, str, int]]) -> list[int]:
        """Page of each note: that of the last reference before it, as-of by folio markers, else that of the note itself."""
        folios = [(m.start(), m.end(), (int(m[1]) - 1) * 2 + (1 if m[2].lower() in ("recto", "r") else 2)) for m in _FOLIO_RE.finditer(text)]

        def page_at(place: int) -> int:
            return next((number for start, _, number in reversed(folios) if start <= place), 1)

        out = []
        for number, _, place in notes:
            before = text[: max(0, place - 5)]
            hits = [
                m.start()
                for form in (r"/\s*{}\s", r"\w{}\s", r"[>;]\s*{}[\s,]", r"\s{}[\s,]")
                for m in re.finditer(form.format(number), before)
                if not any(a <= m.start() < b for a, b, _ in folios)
            ]
            out.append(page_at(max(hits)) if hits else page_at(place))
        return out


@F.pandas_udf(FOOTNOTE)
def _footnotes(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        notes = Notes.take(text)[0] if text is not None else []
        pages = Notes.pages(text, notes) if notes else []
        out.append([{"ref": n, "note": c, "page": p} for (n, c, _), p in zip(notes, pages, strict=True)] if text is not None else None)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _without_footnotes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: Notes.take(t)[1], na_action="ignore")


def footnotes(text: Column) -> Column:
    """Array of (ref, note, page)."""
    return _footnotes(text)


def without_footnotes(text: Column) -> Column:
    """The text without its footnotes."""
    return _without_footnotes(text)


# Names that a bracket may hold, and how the extraction and its annotations are rewritten, in this order.
MARKER_NAMES = "cruz|rúbrica|signo|ilegible|blanco|roto|nota|sic|interlineado|tachado|margen|firma|sobrescrito|encabezamiento"
PAGE_RULES = (
    (r"\n\n- ([a-záéíóúñçü])", "\n$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?iu)\[\s*\n\s*((?:Fol\.?|Folio)\s+\d+\s*,?\s*(?:recto|vuelto|vuelta|r|v))\s*\n\s*\]", "[ $1 ]"),
    (r"(?m)^\s*\|[-|\s:]+\|\s*$\n?", ""),
    (r"(?m)^\s*\|\s*|\s*\|\s*$", ""),
    (r"(?m)(?<=\S)[ \t]*\|[ \t]*(?=\S)", " "),
    (r"(?iu)\(\s*_?Cruz_?\s*\)", "[cruz]"),
    (r"\(\s*_?[Rr]úbrica_?\s*\)", "[rúbrica]"),
    (r"<\s*>\s*(?:\d+\s*)?", ""),
    (r"<\s*(.*?)\s*>\s*(?:\d+\s*)?", "[interlineado: $1] "),
    (r"(?iu)\[\s*_?Al margen_?\s*\]\s*([^\n]*?)\s*(?=\n|\z)", "[margen: $1]"),
    (FOLIO, ""),
    (r"\[\s*_?[Tt]achado:?_?\s*[:,]?\s*([^\]]*?)\s*\]", "[tachado: $1]"),
    (r"\[\s*_?sic:?_?\s*:?\s*([^\]]+)\]", "$1"),
    (r"\[\s*_?sic_?\s*\]", "[sic]"),
    (r"\[\s*_([^_]+)_\s*\]", "$1"),
    (rf"\[\s*(?!(?:{MARKER_NAMES})\s*[:\]])([a-záéíóúñç]{{1,5}})\s*\]", "[$1]"),
    (r"\[(?:margen|tachado|interlineado): \]", ""),
    # slashes inside these markers are line breaks of the manuscript; each match goes on where the one before ended
    (r"(\[(?:margen|tachado|interlineado): |(?!\A)\G)([^\]/]*?)\s*/\s*", "$1$2 "),
    (r"\[(\d+)\]", ""),
    (r"_/_", "/"),
)


def _annotations(text: Column) -> Column:
    """Markdown of the extraction undone, annotations of the transcribers as markers."""
    return chain(text, *PAGE_RULES)


def clean_page(text: Column, notes: Column | None = None) -> Column:
    """A page of running text as manuscript lines.

    The slash is the line break of the manuscript, line ends come from the extraction and go; a hyphen before a slash goes as well.
    Slashes inside brackets are no breaks. Notes of the page, an array of (ref, note), lose their numbers in the text
    and come last.
    """
    if notes is not None:
        text = F.aggregate(
            notes,
            text,
            lambda t, n: F.regexp_replace(
                F.regexp_replace(t, F.concat(F.lit(r"(/\s*|\w)"), n["ref"].cast("string"), F.lit(r"(?=\s)")), F.lit("$1")),
                F.concat(F.lit(r"(?m)(/\s*)"), n["ref"].cast("string"), F.lit(r"\s*$")),
                F.lit("$1"),
            ),
        )
    text = _annotations(text)
    text = chain(
        text,
        (r"\n\n+", " ¶ "),
        (r"\n", " "),
        (r"-(\s*(?:¶\s*)?/)", "$1"),
        (r"(/\s*)-", "$1"),
        (r"/(?=[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\])", _KEEP),
    )
    lines = F.transform(F.split(text, "/"), lambda line: strip(F.translate(F.translate(strip(line), "¶", ""), _KEEP, "/")))
    if notes is not None:
        lines = F.concat(lines, F.transform(notes, lambda n: marker("nota", n["note"])))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


@F.pandas_udf(T.StringType())
def _entries(texts: pd.Series) -> pd.Series:
    dated = re.compile(r"^(En\s+[IVXLCDM]+\s+de\s+|Este\s+dicho\s+d[ií]a)", re.I)

    def lines_of(text: str) -> str:
        lines = [line.rstrip().rstrip("/").strip() for line in text.split("\n")]
        lines = [x for x in lines if x and not re.match(r"^\(?\s*Cruz\s*\)?$", x, re.I) and not _FOLIO_RE.match(x)]
        out: list[str] = []
        for line in lines:
            if out and dated.match(line):
                at = len(out)  # the names before a date belong to its entry
                while at and out[at - 1] and not dated.match(out[at - 1]) and len(out[at - 1]) <= 60 and not out[at - 1].endswith("."):
                    at -= 1
                if at < len(out):
                    if out[at]:
                        out.insert(at, "")
                elif out[-1]:
                    out.append("")
            out.append(line)
        return "\n".join(out)

    return texts.map(lines_of, na_action="ignore")


def clean_line_document(text: Column) -> Column:
    """Documents whose line ends count: a blank line is put before each dated entry and the names that head it."""
    return _entries(_annotations(text))


def parse_transcription(text: Column, page: Column, doc: Column | None = None) -> Column:
    """The text of one page of a transcription: front matter, cover offset, folio, notes, cleaning."""
    body = without_front_matter(text)
    number = page - page_offset(body, doc)
    notes = F.filter(footnotes(body), lambda n: n["page"] == number)
    cleaned = clean_page(folio_page(without_footnotes(body), number), notes)
    return F.when(number < 1, F.lit("")).otherwise(cleaned)


def ground_truth(dataset: Column, text: Column, page: Column, doc: Column | None = None) -> Column:
    """The parser of the dataset, then Unicode in one form; unknown datasets give the empty text."""
    return normalize_unicode(
        F.when(dataset == "codea", parse_edition(text)).when(dataset == "toledo", parse_transcription(text, page, doc)).otherwise(F.lit(""))
    )
