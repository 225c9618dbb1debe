"""Reading the layouts in which transcriptions come: JSON catalogues, one file per page, Markdown, XML, HTML, pictures."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escriba.functions.text import strip

# Fields of a description in Markdown, as written and as named.
DESCRIPTION_FIELDS = {
    "FONDO-COLECCIÓN": "fondo",
    "NIVEL DE DESCRIPCIÓN": "nivel_descripcion",
    "PRODUCTOR": "productor",
    "CÓDIGO DE REFERENCIA": "codigo_referencia",
    "FECHA": "fecha",
    "TÍTULO": "titulo",
    "VOLUMEN Y SOPORTE": "volumen_soporte",
    "NOTAS": "notas",
    "DESCRIPTORES": "descriptores",
}

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in "dataset doc_id page siglo letra letra_normalized provincia tipologia copista image_path canonical_name page_id".split()]
    + [T.StructField("gt_paths", T.MapType(T.StringType(), T.StringType()))]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches a path, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    matches = found.getFileSystem(conf).globStatus(found)
    return matches is not None and len(matches) > 0


def manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all JSON manifests; one that is missing gives no rows."""
    out = spark.createDataFrame([], MANIFEST)
    for path in paths:
        if exists(spark, path):
            out = out.unionByName(spark.read.schema(MANIFEST).json(path, multiLine=True))
    return out


def text_files(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per text file, its whole content as ``text``, and parts of its path by the groups of a pattern."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    rows = rows.select(*[F.regexp_extract("path", pattern, i).alias(n) for i, n in enumerate(names, 1)], F.col("value").alias("text"))
    return rows.where(F.col(names[0]) != "")


def model_texts(spark: SparkSession, root: str, stage: str = "normalized") -> DataFrame:
    """(model, page_id, text) of all models under a folder; names with a leading underscore are skipped."""
    base = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    return text_files(spark, root, rf".*/{base}/((?:[^/_][^/]*/)?[^/_][^/]*)/{stage}/([^/]+?)(?:_raw)?\.txt$", ["model", "page_id"])


def ground_truth_texts(spark: SparkSession, root: str) -> DataFrame:
    """(subset, edition, page_id, text) of all subsets under a folder."""
    return text_files(spark, root, r".*/([^/]+)/ground_truth/([^/]+)/([^/]+)\.txt$", ["subset", "edition", "page_id"])


def models(texts: DataFrame) -> DataFrame:
    """S3: names of the models that have texts."""
    return texts.select("model").distinct()


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of metric reports, from files {"results": [...]} and from bare lists."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select(F.explode("results").alias("r")).select("r.*") if "results" in rows.columns else rows


def with_document_metadata(rows: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the documents' metadata; null where a document has none."""
    return rows.join(metadata.select("doc_id", *columns), "doc_id", "left")


def front_matter(text: Column) -> Column:
    """The fields of a leading block as a map, quotes around values taken off."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.+?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda line: line.contains(":"))
    pair = lambda line: F.struct(
        strip(F.substring_index(line, ":", 1)), F.regexp_replace(strip(F.regexp_replace(line, r"^[^:]*:", "")), "^[\"']+|[\"']+$", "")
    )
    return F.map_from_entries(F.transform(lines, pair))


def description(text: Column) -> dict[str, Column]:
    """The fields **NAME=** of a description, by name; single line ends are spaces. A field that is not there is the empty text."""
    names = list(DESCRIPTION_FIELDS)
    out = {}
    for i, name in enumerate(names):
        end = rf"(?=\*\*{re.escape(names[i + 1])}=\*\*)" if i + 1 < len(names) else r"\z"
        value = strip(F.regexp_extract(text, rf"(?s)\*\*{re.escape(name)}=\*\*\s*(.*?){end}", 1))
        out[DESCRIPTION_FIELDS[name]] = F.regexp_replace(F.regexp_replace(value, r"\n\n+", "\n\n"), r"(?<!\n)\n(?!\n)", " ")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node if _local(x.tag) == name]


def page_xml_text(xml: str) -> str:
    """Lines of a PAGE document in its reading order, if it has one; regions that are not in it are left out."""
    root = ET.fromstring(xml)
    every = list(root.iter())

    def line_text(line: ET.Element) -> list[str]:
        return [u.text for e in _children(line, "TextEquiv")[:1] for u in _children(e, "Unicode")[:1] if u.text]

    order = next((x for x in every if _local(x.tag) == "OrderedGroup"), None)
    if order is not None:
        regions = {x.get("id"): x for x in every if _local(x.tag) == "TextRegion"}
        refs = sorted(_children(order, "RegionRefIndexed"), key=lambda r: int(r.get("index", 0)))
        lines = [line for r in refs if r.get("regionRef") in regions for line in _children(regions[r.get("regionRef")], "TextLine")]
    else:
        lines = [x for x in every if _local(x.tag) == "TextLine"]
    return "\n".join(text for line in lines for text in line_text(line))


def alto_xml_text(xml: str) -> str:
    """Lines of an ALTO document; strings follow each other at once, spaces are elements of their own."""
    lines = []
    for line in ET.fromstring(xml).iter():
        if _local(line.tag) == "TextLine":
            parts = [x.get("CONTENT", "") if _local(x.tag) == "String" else " " if _local(x.tag) == "SP" else "" for x in line]
            lines.append("".join(parts))
    return "\n".join(x for x in lines if x)


def tei_tokens(xml: str) -> list[tuple[str, str]]:
    """(layer, form) of the tokens of a TEI document."""
    out = []
    for token in ET.fromstring(xml).iter():
        if _local(token.tag) != "tok":
            continue
        shown, full, norm = ((token.get(a) or "").strip() for a in ("form", "fform", "nform"))
        out += [("paleographic", x) for x in ("".join(token.itertext()).strip(), shown if shown != "--" else "") if x]
        out += [("expanded", full)] if full else []
        out += [("normalized", norm)] if norm and norm not in (",", ".", "--", ";", ":") and "<" not in norm else []
    return out


class _Cells(HTMLParser):
    """Collects rows of a table: class of the row, and per cell its class, texts, picture and links."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "tr":
            self.rows.append({"class": a.get("class") or "", "cells": []})
        elif tag in ("td", "div") and ("class" in a or tag == "td") and self.rows:
            if tag == "td" or self.cell is None:
                self.cell = {"class": a.get("class") or "", "text": [], "img": "", "links": []}
                self.rows[-1]["cells"].append(self.cell)
        elif self.cell is not None and tag == "img":
            self.cell["img"] = a.get("src") or ""
        elif self.cell is not None and tag == "a":
            self.cell["links"].append(a.get("href") or "")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "tr"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None and data.strip():
            self.cell["text"].append(data.strip())


def transcription_table(page: str) -> list[tuple[str, str, str]]:
    """(page, paleographic, critical) of each text row of a document's page; a page without rows is taken as one, 1r."""
    parser = _Cells()
    parser.feed(page)
    out = []
    for row in parser.rows:
        cells = {c["class"]: c for c in row["cells"]}
        paleo, critical = cells.get("textopaleo"), cells.get("textocritico")
        label = re.search(r"CODEA-\d+_(.+)\.jpg", paleo["img"]) if paleo else None
        texts = ["\n".join(c["text"]) if c else "" for c in (paleo, critical)]
        if "tr-texto" in row["class"] and label and any(texts):
            out.append((label[1], *texts))
    if not out:
        found = [re.search(rf'class="[^"]*\b{n}\b[^"]*"[^>]*>(.*?)</(?:td|div)>', page, re.S) for n in ("textopaleo", "textocritico")]
        texts = ["\n".join(x.strip() for x in re.split(r"<[^>]+>", html.unescape(f[1])) if x.strip()) if f else "" for f in found]
        if any(texts):
            out.append(("1r", *texts))
    return out


def document_links(page: str) -> list[tuple[int, str, str, str, str]]:
    """(number, slug, url_cd, url_d, url_t) of each row that links all three documents."""
    parser = _Cells()
    parser.feed(page)
    out = []
    for row in parser.rows:
        links = [u for c in row["cells"] for u in c["links"]]
        found = {kind: next((u for u in links if u.endswith(f"_{kind}.pdf")), "") for kind in ("cd", "d", "t")}
        if all(found.values()):
            slug = found["cd"].rsplit("/", 1)[-1].removesuffix("_cd.pdf")
            out.append((len(out) + 1, slug, found["cd"], found["d"], found["t"]))
    return out


def parsed(rows: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows that a parser makes of each document, with the document's key; what can't be parsed gives none."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text], strict=True):
                try:
                    out += [(k, *found) for found in parse(t)]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(out, columns=[key, *names])

    kept = rows.where(F.col(text).isNotNull()).select(key, text)
    return kept.mapInPandas(work, f"{key} {dict(kept.dtypes)[key]}, {schema}")


def xml_texts(rows: DataFrame, key: str, text: str, form: str = "page") -> DataFrame:
    """(key, text) of PAGE or ALTO documents."""
    read = page_xml_text if form == "page" else alto_xml_text
    return parsed(rows, key, text, lambda xml: [(read(xml),)], "text string")


def inventory(rows: DataFrame, letra: str = "procesal") -> DataFrame:
    """Entries whose script names a kind, with the identifier cut out of the raw one."""
    kept = rows.where(F.lower("letra").contains(letra))
    return kept.withColumn("doc_id", F.regexp_extract("raw_id", r"(CODEA-\d+)", 1)).where("doc_id <> ''")


def facsimiles_found(probes: DataFrame, misses: int = 4) -> DataFrame:
    """Pages found before so many misses one after another: (doc_id, page, place).

    ``probes`` has (doc_id, place, page, found). A page counts if no earlier place ends a run of that many misses.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("place")
    run = F.sum(F.when(~F.col("found"), 1).otherwise(0)).over(order.rowsBetween(-(misses - 1), 0))
    ended = F.max(F.when((run == misses) & (F.col("place") >= misses - 1), 1).otherwise(0)).over(order)
    return probes.withColumn("_ended", ended).where("found AND _ended = 0").select("doc_id", "page", "place")


#: Bytes that a picture may have so that its base 64 form stays within the five megabytes that services take.
PICTURE_BYTES = 5 * 1024 * 1024 * 3 // 4


def pictures(spark: SparkSession, path: str, most_bytes: int = PICTURE_BYTES) -> DataFrame:
    """Pictures with their bytes and length, and the bytes in base 64; larger ones aren't read, see ``oversized``."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    return rows.select("path", "length", "content", F.base64("content").alias("base64"))


def oversized(spark: SparkSession, path: str, most_bytes: int = PICTURE_BYTES) -> DataFrame:
    """(path, length) of the pictures that are beyond the size and would have to be compressed first."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > most_bytes).select("path", "length")
