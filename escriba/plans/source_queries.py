"""Queries of sources, sinks and the stream: tables are written in the layouts that readers know, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escriba.functions import editions, text
from escriba.operators import corpus, knowledge, layout, vocabulary
from escriba.plans import sql
from escriba.plans.core_queries import ORTHOGRAPHY_SQL
from escriba.plans.registry import query
from escriba.sources import readers, sinks
from escriba.sources.tables import scratch, table
from escriba.streaming import metrics as stream

_FIELDS = "dataset doc_id page siglo letra letra_normalized provincia tipologia copista image_path canonical_name page_id".split()


def _json_arrays(rows: DataFrame, path: str) -> str:
    """Rows as files that each hold one JSON array."""

    def join(batches):
        import pandas as pd

        yield pd.DataFrame({"value": ["[" + ",".join(x for batch in batches for x in batch["value"]) + "]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(join, "value string").write.text(path)
    return path


@query("s1_manifests", f"SELECT {', '.join(_FIELDS)} FROM manifest WHERE dataset IS NOT NULL")
def s1_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Two catalogues as JSON arrays, and a third that is missing."""
    base, rows = scratch(spark, "manifests"), table(spark, d, "manifest").select(*_FIELDS)
    paths = [_json_arrays(rows.where(condition), f"{base}-{i}") for i, condition in enumerate(("dataset = 'codea'", "dataset <> 'codea'"))]
    return readers.manifests(spark, *paths, f"{base}-missing").select(*_FIELDS)


def _as_files(spark: SparkSession, d: str) -> str:
    """Transcriptions as text files, one for each."""
    path = scratch(spark, "texts")
    table(spark, d, "transcripcion").where("md IS NOT NULL").select("tr_id", "md").write.partitionBy("tr_id").text(path)
    return path


@query("s2_text_files", "SELECT CAST(tr_id AS VARCHAR) AS tr_id, md || chr(10) AS text FROM transcripcion WHERE md IS NOT NULL")
def s2_text_files(spark, d):
    return readers.text_files(spark, _as_files(spark, d), r"/tr_id=(\d+)/", ["tr_id"])


@query("s16_pictures", "SELECT CAST(tr_id AS VARCHAR) AS tr_id, octet_length(encode(md)) + 1 AS length, base64(encode(md || chr(10))) AS base64 FROM transcripcion WHERE md IS NOT NULL AND octet_length(encode(md)) < 5000")
def s16_pictures(spark, d):
    """Any file's bytes will do: those of up to a size, in base 64."""
    rows = readers.pictures(spark, f"{_as_files(spark, d)}/*/*.txt", most_bytes=5000)
    return rows.select(F.regexp_extract("path", r"/tr_id=(\d+)/", 1).alias("tr_id"), "length", F.translate("base64", "\r\n", "").alias("base64"))


@query("s3_models", "SELECT DISTINCT model FROM hypothesis WHERE model IS NOT NULL AND hyp_text IS NOT NULL")
def s3_models(spark, d):
    path = scratch(spark, "models")
    table(spark, d, "hypothesis").where("model IS NOT NULL AND hyp_text IS NOT NULL").select("model", "hyp_text").write.partitionBy("model").text(path)
    return readers.models(readers.text_files(spark, path, r"/model=([^/]+)/", ["model"]).withColumn("model", F.url_decode(F.url_decode("model"))))  # a folder's name, in a file's address


@query("k2_texts_by_model", "SELECT hyp_id, model, page_id, hyp_text FROM hypothesis WHERE model IS NOT NULL")
def k2_texts_by_model(spark, d):
    path = scratch(spark, "by-model")
    sinks.texts_by_model(table(spark, d, "hypothesis").where("model IS NOT NULL").select("hyp_id", "model", "page_id", "hyp_text"), path)
    return spark.read.parquet(path).select("hyp_id", "model", "page_id", "hyp_text")


_COUNTS = "SELECT model, count(*) AS runs, count(DISTINCT page_id) AS pages FROM hypothesis WHERE model IS NOT NULL GROUP BY model"


def _counts(spark, d):
    return table(spark, d, "hypothesis").where("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("runs"), F.countDistinct("page_id").alias("pages"))


@query("k1_json_report", _COUNTS)
def k1_json_report(spark, d):
    path = scratch(spark, "report")
    sinks.json_report(_counts(spark, d), path)
    return spark.read.schema("model string, runs long, pages long").json(path)


@query("k8_k9_resume", _COUNTS)
def k8_resume(spark, d):
    """Written in two goes, of which the second adds what the first lacks."""
    path, rows = scratch(spark, "resume"), _counts(spark, d)
    sinks.resume(rows.where("model < 'm'"), path, ["model"])
    sinks.resume(rows, path, ["model"])
    sinks.resume(rows, path, ["model"])
    return spark.read.parquet(path)


@query("s6_reports", f"{_COUNTS} UNION ALL ({_COUNTS})")
def s6_reports(spark, d):
    """A report with its rows under "results", and one that is a bare list."""
    path, rows = scratch(spark, "reports"), _counts(spark, d)
    row = F.struct("model", "runs", "pages")
    rows.agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("value")).write.text(f"{path}-a")  # one row a model
    listed = _json_arrays(rows.coalesce(1), f"{path}-b")
    found = [readers.reports(spark, x).select("model", "runs", "pages") for x in (f"{path}-a", listed)]
    return corpus.union_of(*found)


@query(
    "s5_metadata",
    """WITH m AS (SELECT doc_id, arg_min(archivo, entry_id) AS archivo, arg_min(signatura, entry_id) AS signatura FROM document_entry WHERE doc_id IS NOT NULL AND archivo IS NOT NULL AND signatura IS NOT NULL GROUP BY doc_id)
SELECT man_id, archivo, signatura FROM manifest LEFT JOIN m USING (doc_id)""",
)
def s5_metadata(spark, d):
    entries = table(spark, d, "document_entry").where("doc_id IS NOT NULL AND archivo IS NOT NULL AND signatura IS NOT NULL")
    first = entries.groupBy("doc_id").agg(F.min_by("archivo", "entry_id").alias("archivo"), F.min_by("signatura", "entry_id").alias("signatura"))
    return readers.with_document_metadata(table(spark, d, "manifest"), first, ["archivo", "signatura"]).select("man_id", "archivo", "signatura")


def _aliases(spark, d):
    return table(spark, d, "letra_reference").select(F.col("letra_id").alias("id"), F.col("letra").alias("abbreviated"), F.array_join("aliases", " / ").alias("expanded"))


_ALIASES = "SELECT lower(letra) AS abbreviated, lower(trim(split_part(array_to_string(aliases, ' / '), '/', 1))) AS expanded FROM letra_reference"


@query("s8_abbreviations", _ALIASES)
def s8_abbreviations(spark, d):
    return vocabulary.abbreviations(_aliases(spark, d))


@query("v10_abbreviation_table", f"WITH a AS ({_ALIASES}) SELECT '{{' || string_agg('\"' || abbreviated || '\":\"' || expanded || '\"', ',' ORDER BY abbreviated) || '}}' AS \"table\" FROM a")
def v10_abbreviation_table(spark, d):
    return knowledge.abbreviation_table(vocabulary.abbreviations(_aliases(spark, d)))


@query("v10_alternations", f"SELECT feature, '- ' || feature || ': ' || n || ' occurrences — ' || array_to_string(examples[1:3], ', ') AS line FROM ({ORTHOGRAPHY_SQL})")
def v10_alternations(spark, d):
    return knowledge.alternation_lines(corpus.orthography(table(spark, d, "gt_page"), "gt_text"))


@query("v10_combined")
def v10_combined(spark, d):
    mined = vocabulary.abbreviation_groups(vocabulary.abbreviation_instances(table(spark, d, "gt_page"), "gt_id", "gt_text"), "gt_id")
    return knowledge.combined_abbreviations(vocabulary.abbreviations(_aliases(spark, d)), mined)


# --- XML and HTML ----------------------------------------------------------------------------------------------


def _marked(spark, d):
    """Ground truth without characters that XML can't hold or would change, escaped."""
    plain = F.regexp_replace(F.translate("gt_text", "\t\r", "  "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    return table(spark, d, "gt_page").where("gt_text IS NOT NULL").select("gt_id", text.escape_html(plain).alias("t"))


_PLAIN = r"regexp_replace(translate(gt_text, chr(9) || chr(13), '  '), '[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{fffe}\x{ffff}]', '', 'g')"
_LINES = f"list_filter(string_split({_PLAIN}, chr(10)), lambda x: x <> '')"


@query("s9_page_xml", f"SELECT gt_id, array_to_string({_LINES}, chr(10)) AS text FROM gt_page WHERE gt_text IS NOT NULL")
def s9_page_xml(spark, d):
    """Regions stand in the file in another order than they are read in, and one is in no reading order."""
    line = lambda x: F.concat(F.lit("<TextLine><TextEquiv><Unicode>"), x, F.lit("</Unicode></TextEquiv></TextLine>"))
    lines = F.split("t", "\n", -1)
    region = lambda name, items: F.concat(F.lit(f'<TextRegion id="{name}">'), F.array_join(F.transform(items, line), ""), F.lit("</TextRegion>"))
    order = '<ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="rest"/><RegionRefIndexed index="0" regionRef="first"/></OrderedGroup></ReadingOrder>'
    xml = F.concat(
        F.lit(f'<PcGts xmlns="x"><Page>{order}'),
        region("rest", F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))),
        F.lit('<TextRegion id="header"><TextLine><TextEquiv><Unicode>header</Unicode></TextEquiv></TextLine></TextRegion>'),
        region("first", F.slice(lines, 1, 1)),
        F.lit("</Page></PcGts>"),
    )
    return readers.xml_texts(_marked(spark, d).select("gt_id", xml.alias("xml")), "gt_id", "xml")


@query("s10_alto_xml", f"SELECT gt_id, array_to_string({_LINES}, chr(10)) AS text FROM gt_page WHERE gt_text IS NOT NULL")
def s10_alto_xml(spark, d):
    string = lambda w: F.concat(F.lit('<String CONTENT="'), w, F.lit('"/>'))
    line = lambda x: F.concat(F.lit("<TextLine>"), F.array_join(F.transform(F.split(x, " ", -1), string), "<SP/>"), F.lit("</TextLine>"))
    xml = F.concat(F.lit("<alto><Page>"), F.array_join(F.transform(F.split("t", "\n", -1), line), ""), F.lit("</Page></alto>"))
    return readers.xml_texts(_marked(spark, d).select("gt_id", xml.alias("xml")), "gt_id", "xml", "alto")


_TOK = "[a-záéíóúñçüA-ZÁÉÍÓÚÑÇÜ]+"


@query(
    "s11_tei_tokens",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(gt_text, '{_TOK}')) AS w FROM gt_page)
SELECT layer, form, count(*) AS n FROM (SELECT 'paleographic' AS layer, w AS form FROM w UNION ALL SELECT 'paleographic', upper(w) FROM w UNION ALL SELECT 'expanded', w || 's' FROM w UNION ALL SELECT 'normalized', lower(w) FROM w) GROUP BY ALL""",
)
def s11_tei_tokens(spark, d):
    token = lambda w: F.concat(F.lit('<tok form="'), F.upper(w), F.lit('" fform="'), w, F.lit('s" nform="'), F.lower(w), F.lit('">'), w, F.lit("</tok>"))
    words = F.regexp_extract_all("gt_text", F.lit(f"({_TOK})"), F.lit(1))
    xml = F.concat(F.lit("<TEI>"), F.array_join(F.transform(words, token), " "), F.lit("</TEI>"))
    rows = table(spark, d, "gt_page").where("gt_text IS NOT NULL").select("gt_id", xml.alias("xml"))
    return readers.parsed(rows, "gt_id", "xml", readers.tei_tokens, "layer string, form string").groupBy("layer", "form").agg(F.count("*").alias("n"))


_CELL = f"array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: {sql.strip('x')}), lambda x: x <> ''), chr(10))"


@query("s12_html_table", f"SELECT gt_id, 'p' || gt_id AS page, {_CELL} AS paleographic, {_CELL} AS critical FROM gt_page WHERE {_CELL} <> ''")
def s12_html_table(spark, d):
    lines = F.replace("t", F.lit("\n"), F.lit("<br>"))
    page = F.concat(
        F.lit('<table><tr class="tr-texto"><td class="textopaleo"><img src="/f/CODEA-0001_p'), F.col("gt_id").cast("string"), F.lit('.jpg">'), lines,
        F.lit('</td><td class="textocritico">'), lines, F.lit("</td></tr></table>"),
    )
    return readers.parsed(_marked(spark, d).select("gt_id", page.alias("html")), "gt_id", "html", readers.transcription_table, "page string, paleographic string, critical string")


@query(
    "s13_html_catalogue",
    """SELECT entry_id, 1 AS number, 'e' || entry_id AS slug, '/x/e' || entry_id || '_cd.pdf' AS url_cd, '/x/e' || entry_id || '_d.pdf' AS url_d, '/x/e' || entry_id || '_t.pdf' AS url_t
FROM document_entry WHERE downloaded""",
)
def s13_html_catalogue(spark, d):
    """Entries that were not downloaded lack one of the three links."""
    link = lambda kind: F.concat(F.lit('<a href="/x/e'), F.col("entry_id").cast("string"), F.lit(f'_{kind}.pdf"></a>'))
    page = F.concat(F.lit("<table><tr><td>x</td><td>"), link("cd"), link("d"), F.when(F.col("downloaded"), link("t")).otherwise(""), F.lit("</td></tr></table>"))
    rows = table(spark, d, "document_entry").select("entry_id", page.alias("html"))
    return readers.parsed(rows, "entry_id", "html", readers.document_links, "number int, slug string, url_cd string, url_d string, url_t string")


@query("s15_description", "SELECT entry_id, coalesce(provincia, '') AS fondo, coalesce(tipologia, '') AS nivel_descripcion, coalesce(copista, '') AS productor, coalesce(signatura, '') AS descriptores FROM document_entry")
def s15_description(spark, d):
    fields = {"FONDO-COLECCIÓN": "provincia", "NIVEL DE DESCRIPCIÓN": "tipologia", "PRODUCTOR": "copista", "CÓDIGO DE REFERENCIA": None, "FECHA": None, "TÍTULO": None, "VOLUMEN Y SOPORTE": None, "NOTAS": None, "DESCRIPTORES": "signatura"}
    parts = [x for name, column in fields.items() for x in (F.lit(f"**{name}=** "), F.coalesce(column, F.lit("")) if column else F.lit("x"), F.lit("\n"))]
    found = readers.description(F.col("md"))
    rows = table(spark, d, "document_entry").select("entry_id", F.concat(*parts).alias("md"))
    return rows.select("entry_id", *[found[n].alias(n) for n in ("fondo", "nivel_descripcion", "productor", "descriptores")])


# --- filters and parsers ---------------------------------------------------------------------------------------


@query("f10_letra_in_text", r"SELECT entry_id, lower(trim(nullif(regexp_extract('Escritura con Letra ' || letra || '.', '[Ll]etra\s+([\w\s\-/áéíóúñçÁÉÍÓÚÑÇüÜ]+?)(?:\.|,|\n)', 1), ''))) AS letra FROM document_entry WHERE regexp_full_match(letra, '[\wáéíóúñçÁÉÍÓÚÑÇüÜ /\-]+')")
def f10_letra_in_text(spark, d):
    rows = table(spark, d, "document_entry").where(F.col("letra").rlike(r"^[\wáéíóúñçÁÉÍÓÚÑÇüÜ /\-]+\z"))
    return rows.select("entry_id", text.letra_in_text(F.concat(F.lit("Escritura con Letra "), F.col("letra"), F.lit("."))).alias("letra"))


_PARTS = "SELECT p_partkey AS box_id, p_size AS side, CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'picture' WHEN 2 THEN 'table' ELSE 'stamp' END AS class_name FROM part"


@query("f11_large_enough", f"WITH b AS ({_PARTS}) SELECT box_id, CASE class_name WHEN 'text' THEN 'main_text' WHEN 'picture' THEN 'graphic' ELSE 'table' END AS region_type FROM b WHERE class_name <> 'stamp' AND side * 20 * 10 >= 400 * 400 * 0.01")
def f11_large_enough(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("text", "picture", "table", "stamp")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    boxes = table(spark, d, "part").select(F.col("p_partkey").alias("box_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), (F.col("p_size") * 20).alias("x2"), F.lit(10).alias("y2"), F.lit(400).alias("page_width"), F.lit(400).alias("page_height"), name.alias("class_name"))
    classes = spark.createDataFrame([("text", "main_text"), ("picture", "graphic"), ("table", "table")], "class_name string, region_type string")
    return layout.large_enough(boxes, classes).select("box_id", "region_type")


@query("f12_badges", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 OR o_custkey % 11 = 0 THEN 'error' WHEN CAST(o_custkey % 3000 AS DOUBLE) * 700 / 1000000 < 1.0 THEN 'warn' ELSE 'ok' END AS badge FROM orders")
def f12_badges(spark, d):
    key = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", layout.quality_badge(key % 3000, F.lit(700), key % 7 != 0, key % 11 != 0).alias("badge"))


@query(
    "f14_decisions",
    """WITH a AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'merge' WHEN 2 THEN 'transcribe' ELSE 'unclear' END AS said FROM orders)
SELECT o_orderkey, unnest([CASE WHEN said = 'unclear' THEN 'transcribe' ELSE said END, 'transcribe']) AS action FROM a""",
)
def f14_decisions(spark, d):
    """Two boxes, of which an answer speaks of the first alone."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("skip", "merge 1", "transcribe", "unclear")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", layout.parse_decisions(F.concat(F.lit("So I say:\n 0: "), said), F.lit(2)).alias("a"))
    return rows.select("o_orderkey", F.explode("a").alias("x")).select("o_orderkey", "x.action")


@query("n11_line_documents")
def n11_line_documents(spark, d):
    return table(spark, d, "transcripcion").select("tr_id", editions.clean_line_document(editions.without_front_matter(F.col("md"))).alias("text"))


@query("n15_markers", f"SELECT entry_id, CASE WHEN {sql.collapse(chr(39).join(['translate(regesto, ', '/', ', ', ' ', ')']))} = '' THEN '' ELSE '[nota: ' || {sql.collapse(chr(39).join(['translate(regesto, ', '/', ', ', ' ', ')']))} || ']' END AS text FROM document_entry WHERE regesto IS NOT NULL")
def n15_markers(spark, d):
    return table(spark, d, "document_entry").where("regesto IS NOT NULL").select("entry_id", editions.marker("nota", F.col("regesto")).alias("text"))


@query("u1_all_forms", "SELECT lower(form) AS form FROM vocab UNION ALL SELECT lower(letra) FROM letra_reference")
def u1_all_forms(spark, d):
    return corpus.union_of(table(spark, d, "vocab").select(F.lower("form").alias("form")), table(spark, d, "letra_reference").select(F.lower("letra").alias("form")))


@query("k4_corpus_report", "SELECT section, item, n FROM (SELECT 'totals' AS section, 'pages' AS item, count(*) AS n FROM gt_page WHERE gt_text IS NOT NULL UNION ALL SELECT 'totals', 'characters', CAST(sum(length(gt_text)) AS BIGINT) FROM gt_page WHERE gt_text IS NOT NULL UNION ALL SELECT 'totals', 'missing', count(*) FROM gt_page WHERE gt_text IS NULL UNION ALL "
    + "SELECT 'markers', marker, n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS marker, CAST(sum(len(regexp_extract_all(replace(gt_text, chr(10), ''), '(?i){p}'))) AS BIGINT) AS n FROM gt_page" for n, p in corpus.MARKER_PATTERNS.items()) + ") WHERE n > 0)")
def k4_corpus_report(spark, d):
    """The parts of the report that are counts; spellings and abbreviations come with it in corpus.corpus_report."""
    rows = corpus.corpus_report(table(spark, d, "gt_page"), "gt_id", "gt_text")
    return rows.where("section IN ('totals', 'markers')").select("section", "item", "n")


@query("k4_markdown")
def k4_markdown(spark, d):
    return sinks.report_lines(corpus.corpus_report(table(spark, d, "gt_page"), "gt_id", "gt_text"))


@query("k7_split_files", "SELECT doc_id, count(*) AS pages FROM manifest WHERE doc_id IS NOT NULL GROUP BY doc_id")
def k7_split_files(spark, d):
    """Documents of both sides of a split, from the files that the split is written to."""
    from escriba.operators import sampling

    path = scratch(spark, "split")
    sinks.split_files(sampling.train_documents(table(spark, d, "manifest")), path)
    return spark.read.schema("doc_id string, pages long").json(path).select("doc_id", "pages")


# --- stream ----------------------------------------------------------------------------------------------------


@query(
    "stream_scored",
    f"WITH {sql.SCORED} SELECT DISTINCT model, page_id, subset, edition, round(CASE WHEN gt_chars = 0 THEN CASE WHEN hyp_chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE distance / gt_chars END, 9) AS cer FROM scored",
)
def stream_scored(spark, d):
    """The hypotheses as a stream of files, scored against the ground truth, written, and read back."""
    path, rows = scratch(spark, "stream"), table(spark, d, "hypothesis").where("model IS NOT NULL")
    rows.write.parquet(f"{path}/in")
    scored = stream.scored_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), table(spark, d, "gt_page"))
    stream.run(scored, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("model", "page_id", "subset", "edition", F.round("cer", 9).alias("cer")).distinct()
