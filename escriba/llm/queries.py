"""The queries of the problems' operators over the tables of a data folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escriba.llm import canonical, containers, leakage, lookalikes, proportions, related_splits, residue, scans
from escriba.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that the sample leaves short because they have fewer documents than they need."""
    report = proportions.sample_report(table(spark, folder, "manifest"), table(spark, folder, "letra_target"))
    return report.where("drawn < needed AND available < needed").select("siglo", "letra_normalized")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample itself."""
    return proportions.proportional_sample(table(spark, folder, "manifest"), table(spark, folder, "letra_target"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per cell what was wanted, available and drawn."""
    return proportions.sample_report(table(spark, folder, "manifest"), table(spark, folder, "letra_target"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a page's ground truth and hypothesis that look alike though their characters differ."""
    return lookalikes.same_look_pairs(table(spark, folder, "gt_page"), table(spark, folder, "hypothesis"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of both tables with the class of the texts that look like it."""
    gt = lookalikes.same_look_classes(table(spark, folder, "gt_page"), "gt_id", "gt_text").withColumnRenamed("gt_id", "rec_id")
    hyp = lookalikes.same_look_classes(table(spark, folder, "hypothesis"), "hyp_id", "hyp_text").withColumnRenamed("hyp_id", "rec_id")
    return gt.unionByName(hyp)


def _scanned(spark: SparkSession, folder: str) -> tuple[DataFrame, scans.Repair]:
    gt = table(spark, folder, "gt_page").select(F.col("gt_id").alias("rec"), F.col("gt_text").alias("scan"), "page_id")
    whole = table(spark, folder, "transcripcion").select(F.col("tr_id").alias("rec"), F.col("md").alias("scan"))
    rows = gt.select("rec", "scan").unionByName(whole)
    return rows, scans.trained(table(spark, folder, "vocab"), table(spark, folder, "gt_page"), rows, "scan")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are furniture, or have a word that is broken off or misread."""
    rows, model = _scanned(spark, folder)
    return scans.repairs(rows, "rec", "scan", model).select("rec_id", "line_no", "kind").distinct()


def p3_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every repair: the line, what was read and what is meant."""
    rows, model = _scanned(spark, folder)
    return scans.repairs(rows, "rec", "scan", model)


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired texts in paragraphs."""
    rows, model = _scanned(spark, folder)
    return scans.repaired(rows, "rec", "scan", model)


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    reference = table(spark, folder, "letra_reference")
    entries = canonical.map_values(table(spark, folder, "document_entry"), "entry_id", "letra", reference)
    pages = canonical.map_values(table(spark, folder, "manifest"), "man_id", "letra_normalized", reference)
    return entries.unionByName(pages)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Freely typed script names with the entry that is meant, or 0."""
    return _mapped(spark, folder).where("how <> 'same' OR letra_id = 0").select("rec_id", "letra_id")


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values without an entry and how often they occur."""
    return canonical.unmatched_values(_mapped(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that must stay together."""
    return related_splits.related_pairs(table(spark, folder, "manifest"))


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component and split."""
    return related_splits.assign_splits(table(spark, folder, "manifest"), table(spark, folder, "split_target"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    capacity = containers.capacity_of(table(spark, folder, "container_spec"))
    return containers.pack_documents(table(spark, folder, "documents"), capacity), capacity


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be split over containers."""
    return containers.split_documents(_packed(spark, folder)[0])


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its container."""
    return _packed(spark, folder)[0]


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, against the lower bound."""
    return containers.packing_report(*_packed(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Passages and the documents that they leaked into."""
    return p7_leaks(spark, folder).select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the words of the piece and its similarity."""
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_passage"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue, filler, error messages or notices."""
    return residue.residue(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the kinds of what was found."""
    return residue.residue(table(spark, folder, "documents"))


def p8_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The mined templates that were judged to be messages or filler, and how many documents hold them."""
    documents = table(spark, folder, "documents")
    model = residue.trained(documents)
    return residue.templates(residue.mined(documents, model), model).where("kind IS NOT NULL").select("template", "kind", "documents")


P1_FOUND_SQL = """
WITH docs AS (
  SELECT DISTINCT doc_id, letra_normalized,
    CASE WHEN siglo IN ('XV', 'XVI', 'XVII') THEN siglo
         WHEN regexp_matches(siglo, '^[0-9]{4}') THEN
           CASE WHEN CAST(substr(siglo, 1, 4) AS INT) < 1500 THEN 'XV'
                WHEN CAST(substr(siglo, 1, 4) AS INT) < 1600 THEN 'XVI' ELSE 'XVII' END
    END AS siglo
  FROM manifest WHERE doc_id IS NOT NULL),
size AS (SELECT CAST(floor(count(DISTINCT doc_id) / 5.0) AS BIGINT) AS n FROM manifest),
have AS (SELECT siglo, letra_normalized, count(DISTINCT doc_id) AS available FROM docs GROUP BY ALL)
SELECT t.siglo, t.letra_normalized
FROM letra_target t CROSS JOIN size LEFT JOIN have h ON h.siglo = t.siglo AND h.letra_normalized = t.letra_normalized
WHERE coalesce(h.available, 0) < greatest(t.min_docs, CAST(floor(t.target_permille * n / 1000) AS BIGINT))
"""

P6_FOUND_SQL = """
SELECT DISTINCT doc_id FROM documents, container_spec WHERE octet_length(encode(text)) + 1 > capacity_tokens
"""

P5_FOUND_SQL = r"""
WITH RECURSIVE docs AS (SELECT DISTINCT doc_id, page_id FROM manifest WHERE doc_id IS NOT NULL),
flat AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(doc_id), '[^a-z0-9]+', ' ', 'g')) AS f FROM docs),
keys AS (
  SELECT doc_id, CASE
    WHEN regexp_matches(f, '^[a-z]* ?[0-9]+ [0-9]{4} ?[0-9]{2} ?[0-9]{2}$')
      THEN 'd' || regexp_replace(f, '^([a-z]*) ?0*([0-9]+?) ([0-9]{4}) ?([0-9]{2}) ?([0-9]{2})$', '\1|\2|\3|\4|\5')
    WHEN regexp_matches(f, '^[a-z]+ ?[0-9]+$') THEN 'p' || regexp_replace(f, '^([a-z]+) ?0*([0-9]+)$', '\1|\2') END AS k
  FROM flat),
edges AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM docs a JOIN docs b ON a.page_id = b.page_id AND a.doc_id <> b.doc_id
  UNION SELECT a.doc_id, b.doc_id FROM keys a JOIN keys b ON a.k = b.k AND a.doc_id <> b.doc_id),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT DISTINCT a AS doc_a, b AS doc_b FROM reach WHERE a < b
"""


def queries() -> dict[str, Query]:
    """Queries by name."""
    named = [p1_found, p1_sample, p1_report, p2_found, p2_classes, p3_found, p3_repairs, p3_text, p4_found, p4_unmatched, p5_found, p5_splits]
    named += [p6_found, p6_containers, p6_report, p7_found, p7_leaks, p8_found, p8_kinds, p8_templates]
    return {fn.__name__: fn for fn in named}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express."""
    return {"p1_found": P1_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p6_found": P6_FOUND_SQL}
