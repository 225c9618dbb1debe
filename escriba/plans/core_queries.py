"""The core queries over the tables of a data folder, each over whole tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escriba.functions import align, editions, metrics, text
from escriba.operators import corpus, errors, evaluation, layout, matching, pairs, quality, sampling, stats, vocabulary
from escriba.plans import sql
from escriba.plans.registry import query, sql_of
from escriba.sources import readers
from escriba.sources.tables import table

KEYS = evaluation.KEYS


def _compared(spark: SparkSession, d: str, mode: str = "content") -> DataFrame:
    return evaluation.compared(table(spark, d, "gt_page"), table(spark, d, "hypothesis"), mode)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Distances and lengths of all pairs."""
    rows = _compared(spark, d)
    return rows.select(*KEYS, align.edit_distance(F.col("ref"), F.col("hyp")).alias("distance"), F.length("ref").alias("gt_chars"), F.length("hyp").alias("hyp_chars"))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("gt_chars") == 0, F.when(F.col("hyp_chars") > 0, 1.0).otherwise(0.0)).otherwise(F.col("distance") / F.col("gt_chars"))
    return _scored(spark, d).withColumn("cer", rate)


RATE_SQL = "CASE WHEN gt_chars = 0 THEN CASE WHEN hyp_chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE distance / gt_chars END"


# --- text functions --------------------------------------------------------------------------------------------


@query("n1_whitespace", f"SELECT gt_id, {sql.collapse('gt_text')} AS text FROM gt_page")
def n1_whitespace(spark, d):
    return table(spark, d, "gt_page").select("gt_id", text.collapse_whitespace(F.col("gt_text")).alias("text"))


@query(
    "n2_n5_tiers",
    f"SELECT hyp_id, {sql.t1('hyp_text')} AS t1, {sql.t2('hyp_text')} AS t2, {sql.t3('hyp_text')} AS t3, {sql.t4('hyp_text')} AS t4 FROM hypothesis",
)
def n2_n5_tiers(spark, d):
    t = F.col("hyp_text")
    return table(spark, d, "hypothesis").select("hyp_id", text.tier1(t).alias("t1"), text.tier2(t).alias("t2"), text.tier3(t).alias("t3"), text.tier4(t).alias("t4"))


_QUOTES = "translate(translate({0}, '–—', '--'), chr(8220)||chr(8221)||chr(8216)||chr(8217)||chr(8203)||chr(8204)||chr(8205)||chr(65279), '\"\"''''')"
_BOILER = (
    ("<[^>]+>", ""),
    (rf"(?m)^#+{sql.S}+.*$", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", r"\1"),
    (r"```[^`]*```", ""),
    (rf"(?i)\A(?:here is|the following is|below is|this is).*?transcription.*?:{sql.S}*\n", ""),
    (rf"(?i)\A(?:transcription|transcribed text|output):{sql.S}*\n", ""),
    (r"(?is)\n(?:note:|notes?:|\*note).*\z", ""),
    (r"(?is)\n(?:the text appears|this appears to be|this document).*\z", ""),
    (r"(?is)\n(?:---+).*\z", ""),
)
_ALIASES = (
    (r"(?i)\[rubrica\]", "[rúbrica]"),
    (rf"(?i)\[firmas{sql.S}*:", "[firma:"),
    (r"(?i)\[ill?egible\]", "[ilegible]"),
    (r"\[\.\.\.\]", "[ilegible]"),
    (r"(?i)\[blank\]", "[blanco]"),
)


@query(
    "n6_model_output",
    "SELECT hyp_id, "
    + sql.strip(
        sql.replace(
            sql.replace(_QUOTES.format(f"nfc_normalize({sql.replace('hyp_text', *_BOILER)})"), *_ALIASES),
            (f"{sql.S_BUT_LF}+", " "),
            (" *\n *", "\n"),
            ("\n{3,}", "\n\n"),
        )
    )
    + " AS text FROM hypothesis",
)
def n6_model_output(spark, d):
    return pairs.busy(table(spark, d, "hypothesis")).select("hyp_id", text.normalize_model_output(F.col("hyp_text"), F.col("model")).alias("text"))


@query(
    "n7a_markers",
    f"SELECT gt_id, {sql.markers('gt_text', 'content')} AS content, {sql.markers('gt_text', 'lenient')} AS lenient FROM gt_page",
)
def n7a_markers(spark, d):
    t = F.col("gt_text")
    return pairs.busy(table(spark, d, "gt_page")).select("gt_id", text.strip_markers(t, "content").alias("content"), text.strip_markers(t, "lenient").alias("lenient"))


def _keep_text_sql(t: str) -> str:
    for name in ("firma", "tachado", "margen", "interlineado", "sobrescrito", "encabezamiento", "nota", "mano[^:]*"):
        t = sql.replace(t, (rf"\[{name}:{sql.S}*(.*?)\]", r"\1"))
    return sql.replace(t, (r"\[blanco\]", " "), (r"\[(?:signo|rúbrica|cruz|ilegible|roto)\]", ""))


@query("n7b_error_analysis", f"SELECT gt_id, {sql.collapse(f'nfc_normalize({_keep_text_sql('gt_text')})')} AS text FROM gt_page")
def n7b_error_analysis(spark, d):
    return table(spark, d, "gt_page").select("gt_id", text.for_error_analysis(F.col("gt_text")).alias("text"))


@query("n20_resolution", f"SELECT hyp_id, {sql.collapse(sql.review_markers('nfc_normalize(hyp_text)'))} AS text FROM hypothesis")
def n20_resolution(spark, d):
    return table(spark, d, "hypothesis").select("hyp_id", text.for_resolution_experiment(F.col("hyp_text")).alias("text"))


@query("n16_unicode", "SELECT gt_id, " + sql.strip(sql.replace(_QUOTES.format("nfc_normalize(gt_text)"), (f"{sql.S_BUT_LF}+", " "), (" *\n *", "\n"))) + " AS text FROM gt_page")
def n16_unicode(spark, d):
    return table(spark, d, "gt_page").select("gt_id", text.normalize_unicode(F.col("gt_text")).alias("text"))


@query(
    "n18_clean_form",
    r"""
WITH words AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS word FROM documents),
low AS (SELECT word, trim(regexp_replace(replace(lower(trim(word)), '=', ''), '&#[0-9]+;', '', 'g')) AS f FROM words WHERE word IS NOT NULL AND word <> '')
SELECT word, CASE WHEN NOT (contains(f, ' ') OR f = '' OR regexp_matches(f, '["$]') OR regexp_matches(f, '^[-.,;:!?¿¡–—()\[\]{}«»"''/\\|_=+$&@#]*$')
   OR regexp_matches(replace(f, '&amp;', '&'), '^[0-9.,/:;ªº]+$') OR regexp_matches(f, '[0-9¹²³⁰-⁹]')
   OR (length(f) = 1 AND f NOT IN ('a','e','o','y','i','u'))
   OR (length(f) = 2 AND f NOT IN ('al','de','el','en','es','la','le','lo','me','mi','no','ni','os','se','si','su','te','tu','un','ya','yo','do','ha','he','ir')))
  THEN replace(f, '&amp;', '&') END AS form FROM low""",
)
def n18_clean_form(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", text.clean_form(F.col("word")).alias("form"))


@query("n21_escape", "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM documents")
def n21_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("text"))


@query(
    "f4_letra",
    f"""WITH v AS (SELECT man_id, {sql.strip("lower(letra)")} AS l FROM manifest)
SELECT man_id, CASE WHEN contains(l, 'encadenada') THEN 'procesal encadenada' WHEN l = 'procesal' OR starts_with(l, 'procesal/') THEN 'procesal'
  WHEN contains(l, 'cortesana') OR contains(l, 'cortesano') THEN 'cortesana/procesal' WHEN contains(l, 'humanística') THEN 'humanística/procesal' ELSE l END AS letra FROM v""",
)
def f4_letra(spark, d):
    return table(spark, d, "manifest").select("man_id", text.normalize_letra(F.col("letra")).alias("letra"))


@query(
    "f5_siglo",
    """WITH v AS (SELECT man_id, siglo AS s, try_cast(substr(siglo, 1, 4) AS INT) AS y FROM manifest)
SELECT man_id, CASE WHEN s IN ('XV', 'XVI', 'XVII') THEN s WHEN y < 1500 THEN 'XV' WHEN y < 1600 THEN 'XVI' WHEN y IS NOT NULL THEN 'XVII' ELSE 'unknown' END AS siglo FROM v""",
)
def f5_siglo(spark, d):
    return table(spark, d, "manifest").select("man_id", text.normalize_siglo(F.col("siglo")).alias("siglo"))


@query(
    "f6_paths",
    """SELECT man_id, concat_ws('_', dataset, doc_id, page) AS page_key,
  'data/corpora/' || dataset || '/documents/' || doc_id || '/facsimiles/' || page || '.jpg' AS image FROM manifest""",
)
def f6_paths(spark, d):
    return quality.paths(table(spark, d, "manifest")).select("man_id", "page_key", "image")


@query("sample_p4_page_parts", r"SELECT man_id, regexp_extract(page_id, '(?s)^(.*)_([^_]*)$', 1) AS doc, regexp_extract(page_id, '(?s)^(.*)_([^_]*)$', 2) AS page FROM manifest")
def page_parts(spark, d):
    doc, page = sampling.split_id(F.col("page_id"))
    return table(spark, d, "manifest").select("man_id", doc.alias("doc"), page.alias("page"))


# --- pair metrics ----------------------------------------------------------------------------------------------


_WORDS = "list_filter(string_split_regex({0}, ' +'), lambda w: w <> '')"
_WER = f"CASE WHEN ref = '' THEN CASE WHEN hyp <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {sql.distance(_WORDS.format('ref'), _WORDS.format('hyp'), 'words')} / len({_WORDS.format('ref')}) END"
_NLS = "CASE WHEN greatest(gt_chars, hyp_chars) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - distance / greatest(gt_chars, hyp_chars) END"


@query(
    "m1_m5_core",
    f"""WITH {sql.SCORED} SELECT subset, edition, page_id, model, round({RATE_SQL}, 9) AS cer, round({_NLS}, 9) AS nls, round({_WER}, 9) AS wer,
  CASE WHEN ref = hyp THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ser, CAST(distance AS INT) AS distance, CAST(gt_chars AS INT) AS gt_chars, CAST(hyp_chars AS INT) AS hyp_chars FROM scored""",
)
def m1_m5_core(spark, d):
    """Lines are joined by then, so that the line error is that of one line."""
    rows = evaluation.core_metrics(_compared(spark, d))
    return rows.select(*KEYS, *[F.round(c, 9).alias(c) for c in ("cer", "nls", "wer")], "ser", "distance", "gt_chars", "hyp_chars")


_TIER_SQL = (("T1_raw", sql.t1), ("T2_nospace", sql.t2), ("T3_lowercase", sql.t3), ("T4_alnum", sql.t4))
_TIERED = f"""{sql.PAIRS}, tiered AS (SELECT subset, edition, page_id, model, {", ".join(f"{fn(side)} AS {side}_{n}" for n, fn in _TIER_SQL for side in ("ref", "hyp"))} FROM pairs),
rated AS (SELECT subset, edition, page_id, model, {", ".join(f"CASE WHEN length(ref_T1_raw) = 0 THEN CASE WHEN length(hyp_T1_raw) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {sql.distance(f'ref_{n}', f'hyp_{n}')} / length(ref_T1_raw) END AS {n}" for n, _ in _TIER_SQL)} FROM tiered)"""


@query("m8_tiers", f"WITH {_TIERED} SELECT subset, edition, page_id, model, {', '.join(f'round({n}, 9) AS {n}' for n, _ in _TIER_SQL)} FROM rated")
def m8_tiers(spark, d):
    rows = evaluation.tier_metrics(table(spark, d, "gt_page"), table(spark, d, "hypothesis"))
    return rows.select(*KEYS, *[F.round(t, 9).alias(t) for t in text.TIERS])


@query(
    "m8_tier_lengths",
    f"WITH {sql.PAIRS} SELECT subset, edition, page_id, model, "
    + ", ".join(f"length({fn(side)}) AS {name}_{side}" for name, fn in (("T1_raw", sql.t1), ("T2_nospace", sql.t2), ("T3_lowercase", sql.t3), ("T4_alnum", sql.t4)) for side in ("ref", "hyp"))
    + " FROM pairs",
)
def m8_tier_lengths(spark, d):
    return evaluation.tier_lengths(_compared(spark, d))


@query(
    "m9_boc_difference",
    f"""WITH {sql.PAIRS}, numbered AS (SELECT row_number() OVER () AS n, * FROM pairs),
chars AS (SELECT n, unnest(string_split(ref, '')) AS c, 1 AS v FROM numbered WHERE ref <> '' UNION ALL SELECT n, unnest(string_split(hyp, '')), -1 FROM numbered WHERE hyp <> ''),
diffs AS (SELECT n, sum(abs(s)) AS diff FROM (SELECT n, c, sum(v) AS s FROM chars GROUP BY n, c) GROUP BY n)
SELECT subset, edition, page_id, model, CAST(coalesce(diff, 0) AS INT) AS difference, CAST(greatest(length(ref), length(hyp)) AS INT) AS longest FROM numbered LEFT JOIN diffs USING (n)""",
)
def m9_boc_difference(spark, d):
    ref, hyp = F.col("ref"), F.col("hyp")
    return _compared(spark, d).select(*KEYS, metrics.boc_difference(ref, hyp).alias("difference"), F.greatest(F.length(ref), F.length(hyp)).alias("longest"))


_BAGS = f"""{sql.SCORED}, numbered AS (SELECT row_number() OVER () AS n, * FROM scored),
chars AS (SELECT n, unnest(string_split(ref, '')) AS c, 1 AS v FROM numbered WHERE ref <> '' UNION ALL SELECT n, unnest(string_split(hyp, '')), -1 FROM numbered WHERE hyp <> ''),
diffs AS (SELECT n, sum(abs(s)) AS diff FROM (SELECT n, c, sum(v) AS s FROM chars GROUP BY n, c) GROUP BY n),
ordered AS (SELECT subset, edition, page_id, model, distance, gt_chars, hyp_chars, ref, hyp, CASE WHEN greatest(gt_chars, hyp_chars) = 0 THEN 0.0::DOUBLE ELSE coalesce(diff, 0) / greatest(gt_chars, hyp_chars) END AS boc,
  {RATE_SQL} AS cer FROM numbered LEFT JOIN diffs USING (n))"""


@query("m9_m10_order", f"WITH {_BAGS} SELECT subset, edition, page_id, model, round(boc, 9) AS boc, round(cer, 9) AS cer, round(cer - boc, 9) AS delta_cer FROM ordered")
def m9_m10_order(spark, d):
    rows = evaluation.order_metrics(_compared(spark, d))
    return rows.select(*KEYS, *[F.round(c, 9).alias(c) for c in ("boc", "cer", "delta_cer")])


def _raw_lines(spark, d):
    gt = pairs.distinct_texts(table(spark, d, "gt_page"), "subset", "edition", "page_id", "gt_text").withColumnRenamed("gt_text", "ref")
    hyp = pairs.distinct_texts(table(spark, d, "hypothesis"), "model", "page_id", "hyp_text").withColumnRenamed("hyp_text", "hyp")
    return pairs.by_page(gt, hyp)


@query(
    "m5_line_errors",
    """WITH r AS (SELECT DISTINCT subset, edition, page_id, gt_text AS ref FROM gt_page WHERE gt_text IS NOT NULL AND page_id IS NOT NULL AND subset IS NOT NULL AND edition IS NOT NULL),
h AS (SELECT DISTINCT model, page_id, hyp_text AS hyp FROM hypothesis WHERE hyp_text IS NOT NULL AND page_id IS NOT NULL AND model IS NOT NULL),
p AS (SELECT *, CASE WHEN ref = '' THEN [] ELSE string_split(ref, chr(10)) END AS a, CASE WHEN hyp = '' THEN [] ELSE string_split(hyp, chr(10)) END AS b FROM r JOIN h USING (page_id))
SELECT subset, edition, page_id, model, CAST(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i], '') <> coalesce(b[i], ''))) AS INT) AS wrong,
  CAST(greatest(len(a), len(b)) AS INT) AS lines FROM p""",
)
def m5_line_errors(spark, d):
    wrong, lines = metrics.line_errors(F.col("ref"), F.col("hyp"))
    return _raw_lines(spark, d).select(*KEYS, wrong.alias("wrong"), lines.alias("lines"))


@query(
    "m6_operation_sums",
    f"WITH {sql.SCORED} SELECT subset, edition, page_id, model, CAST(distance AS BIGINT) AS distance, CAST(gt_chars AS BIGINT) AS of_ref, CAST(hyp_chars AS BIGINT) AS of_hyp FROM scored",
)
def m6_operation_sums(spark, d):
    """What the counts of any shortest script must add up to: the distance, and the lengths of both texts."""
    rows = evaluation.decomposition(_compared(spark, d))
    s, l, i, c = (F.col(n) for n in align.COUNTS.names)
    return rows.select(*KEYS, (s + l + i).alias("distance"), (s + l + c).alias("of_ref"), (s + i + c).alias("of_hyp"))


@query("m2_m7_decomposition")
def m2_m7_decomposition(spark, d):
    return evaluation.decomposition(_compared(spark, d))


@query("m11_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m11_cosine(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return matching.cosine_by_key(rows, rows.withColumn("vec_id", F.col("vec_id") - 1), "vec_id").select("vec_id", F.round("cosine", 9).alias("cosine"))


@query(
    "m13_score",
    f"""WITH {sql.SCORED}, s AS (SELECT *, CASE WHEN gt_chars = 0 THEN CASE WHEN hyp_chars = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {RATE_SQL}) END AS score FROM scored)
SELECT subset, edition, page_id, model, round(score, 9) AS score, CASE {" ".join(f"WHEN score >= {least} THEN '{said}'" for least, said in metrics.FEEDBACK)} END AS said FROM s""",
)
def m13_score(spark, d):
    rows = _compared(spark, d).withColumn("score", metrics.score(F.col("ref"), F.col("hyp")))
    said = F.regexp_extract(metrics.feedback(F.col("score")), r"^CER \d+%\. (.*)$", 1)
    return rows.select(*KEYS, F.round("score", 9).alias("score"), said.alias("said"))


@query(
    "m14_cer_or_zero",
    f"WITH {sql.SCORED} SELECT subset, edition, page_id, model, round(CASE WHEN gt_chars = 0 THEN 0.0::DOUBLE ELSE distance / gt_chars END, 9) AS cer FROM scored",
)
def m14_cer_or_zero(spark, d):
    return _compared(spark, d).select(*KEYS, F.round(metrics.cer_or_zero(F.col("ref"), F.col("hyp")), 9).alias("cer"))


@query(
    "m16_bundle",
    f"""WITH {_BAGS} SELECT subset, edition, page_id, model, round(cer, 9) AS cer, round({_NLS}, 9) AS nls, round(boc, 9) AS boc, round(cer - boc, 9) AS delta_cer FROM ordered""",
)
def m16_bundle(spark, d):
    rows = evaluation.page_metrics(table(spark, d, "gt_page"), table(spark, d, "hypothesis"))
    named = {"cer": "cer", "nls": "core.nls", "boc": "order_independent.boc", "delta_cer": "order_independent.delta_cer"}
    return rows.select(*KEYS, *[F.round(path, 9).alias(n) for n, path in named.items()])


@query(
    "f1_excluded",
    f"SELECT gt_id FROM gt_page WHERE page_id NOT IN ({', '.join(repr(p) for p in evaluation.EXCLUDED_PAGES)})",
)
def f1_excluded(spark, d):
    return evaluation.exclude_pages(table(spark, d, "gt_page")).select("gt_id")


@query("m12_entities")
def m12_entities(spark, d):
    """Capitalized words stand for the entities that a model would name."""

    def named(column):
        return F.transform(F.regexp_extract_all(column, F.lit(r"(\p{Lu}\p{Ll}{3,})"), 1), lambda w: F.struct(w.alias("text"), F.lit("NAME").alias("label")))

    rows = _compared(spark, d).select(*KEYS, named(F.col("ref")).alias("ref_entities"), named(F.col("hyp")).alias("hyp_entities"))
    return matching.entity_metrics(rows, KEYS)


# --- aggregates and ranking ------------------------------------------------------------------------------------


@query(
    "a1_model_summary",
    f"""WITH {sql.SCORED}, r AS (SELECT model, {RATE_SQL} AS cer FROM scored)
SELECT model, count(*) AS n_pages, round(avg(cer), 8) AS cer_mean, round(quantile_cont(cer, 0.5), 8) AS cer_median, round(coalesce(stddev_samp(cer), 0), 8) AS cer_stdev, round(min(cer), 8) AS cer_min,
  round(max(cer), 8) AS cer_max FROM r GROUP BY model""",
)
def a1_model_summary(spark, d):
    rows = evaluation.model_summary(_rates(spark, d))
    return rows.select("model", "n_pages", *[F.round(c, 8).alias(c) for c in rows.columns[2:]])


@query("a2_tier_means", f"WITH {_TIERED} SELECT model, {', '.join(f'round(avg({n}), 8) AS {n}' for n, _ in _TIER_SQL)} FROM rated GROUP BY model")
def a2_tier_means(spark, d):
    rows = evaluation.tier_metrics(table(spark, d, "gt_page"), table(spark, d, "hypothesis"))
    return rows.groupBy("model").agg(*[F.round(F.avg(t), 8).alias(t) for t in text.TIERS])


@query(
    "a2_core_means",
    f"""WITH {_BAGS}, m AS (SELECT model, {RATE_SQL} AS cer, {_NLS} AS nls, CASE WHEN ref = hyp THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ser, boc FROM ordered)
SELECT model, round(avg(cer), 8) AS cer, round(avg(nls), 8) AS nls, round(avg(ser), 8) AS ser, round(avg(boc), 8) AS boc, round(avg(round(cer, 6) - boc), 8) AS delta_cer FROM m GROUP BY model""",
)
def a2_core_means(spark, d):
    rows = evaluation.metric_means(table(spark, d, "gt_page"), table(spark, d, "hypothesis"))
    return rows.select("model", *[F.round(c, 8).alias(c) for c in ("cer", "nls", "ser", "boc", "delta_cer")])


@query("a11_operation_means")
def a11_operation_means(spark, d):
    rows = evaluation.metric_means(table(spark, d, "gt_page"), table(spark, d, "hypothesis"))
    return rows.select("model", *[F.round(c, 8).alias(c) for c in ("cer_n", "precision", "recall", "f1", "s_rate", "d_rate", "i_rate")])


@query(
    "a3_strata",
    f"""WITH {sql.SCORED}, {sql.PAGES}, r AS (SELECT model, {RATE_SQL} AS cer, siglo, letra_normalized FROM scored JOIN pages USING (page_id)),
long AS (SELECT model, 'siglo' AS stratum, siglo AS level, cer FROM r UNION ALL SELECT model, 'letra_normalized', letra_normalized, cer FROM r)
SELECT model, stratum, level, count(*) AS n, round(avg(cer), 8) AS mean FROM long WHERE level IS NOT NULL AND trim(level) <> '' GROUP BY ALL""",
)
def a3_strata(spark, d):
    rows = evaluation.stratified(_rates(spark, d), pairs.page_dimension(table(spark, d, "manifest")))
    return rows.withColumn("mean", F.round("mean", 8))


_MODES = ("strict", "content", "lenient")


@query(
    "a4_modes",
    " UNION ALL ".join(f"(WITH {sql.pairs(m)}, scored AS (SELECT model, {sql.distance('ref', 'hyp')} AS distance, length(ref) AS gt_chars, length(hyp) AS hyp_chars FROM pairs) SELECT '{m}' AS mode, model, round(avg({RATE_SQL}), 8) AS cer_mean FROM scored GROUP BY model)" for m in _MODES),
)
def a4_modes(spark, d):
    return evaluation.mode_comparison(table(spark, d, "gt_page"), table(spark, d, "hypothesis")).withColumn("cer_mean", F.round("cer_mean", 8))


@query(
    "a5_ranking",
    f"""WITH {sql.SCORED}, m AS (SELECT model, count(*) AS n_pages, avg({RATE_SQL}) AS cer_mean FROM scored GROUP BY model)
SELECT model, n_pages, round(cer_mean, 8) AS cer_mean, CAST(row_number() OVER (ORDER BY round(cer_mean, 4), model) AS INT) AS rank FROM m""",
)
def a5_ranking(spark, d):
    rows = evaluation.ranking(evaluation.model_summary(_rates(spark, d)))
    return rows.select("model", "n_pages", F.round("cer_mean", 8).alias("cer_mean"), "rank")


@query(
    "a8_boxplot_order",
    f"""WITH {sql.SCORED}, l AS (SELECT model, list_sort(list({RATE_SQL})) AS v FROM scored GROUP BY model)
SELECT model, CAST(len(v) AS INT) AS n, round(v[len(v) // 2 + 1], 8) AS upper_median FROM l""",
)
def a8_boxplot_order(spark, d):
    """The upper median of each model, by which boxes are ordered, from an exact percentile instead of a sorted list."""
    rows = _rates(spark, d).groupBy("model").agg(F.count("*").cast("int").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cer)").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cer DESC)").alias("high"))
    return rows.select("model", "n", F.round(F.when(F.col("n") % 2 == 0, F.col("high")).otherwise(F.col("low")), 8).alias("upper_median"))


LEVELS = ["procesal", "procesal encadenada", "cortesana", "humanística"]


@query(
    "a9_letra_pivot",
    f"""WITH {sql.SCORED}, {sql.PAGES}, r AS (SELECT model, letra_normalized AS l, {RATE_SQL} AS cer FROM scored JOIN pages USING (page_id))
SELECT model, {", ".join(f'round(avg(cer) FILTER (l = {chr(39)}{x}{chr(39)}), 8) AS "{x}"' for x in LEVELS)} FROM r WHERE l IN ({", ".join(f"'{x}'" for x in LEVELS)}) GROUP BY model""",
)
def a9_letra_pivot(spark, d):
    wide = evaluation.pivoted(_rates(spark, d), pairs.page_dimension(table(spark, d, "manifest")), "letra_normalized", LEVELS)
    return wide.select("model", *[F.round(F.col(f"`{x}`"), 8).alias(x) for x in LEVELS])


@query(
    "a10_century_pivot",
    f"""WITH {sql.SCORED}, {sql.PAGES}, r AS (SELECT model, siglo AS l, {RATE_SQL} AS cer FROM scored JOIN pages USING (page_id))
SELECT model, {", ".join(f"coalesce(round(avg(cer) FILTER (l = '{x}'), 8), 0) AS {x}" for x in ("XV", "XVI", "XVII"))} FROM r WHERE l IN ('XV', 'XVI', 'XVII') GROUP BY model""",
)
def a10_century_pivot(spark, d):
    wide = evaluation.pivoted(_rates(spark, d), pairs.page_dimension(table(spark, d, "manifest")), "siglo", ["XV", "XVI", "XVII"], fill=0.0)
    return wide.select("model", *[F.round(x, 8).alias(x) for x in ("XV", "XVI", "XVII")])


@query(
    "a14_micro_average",
    f"""WITH {sql.SCORED}, m AS (SELECT model, CAST(sum(distance) AS BIGINT) AS errors, CAST(sum(gt_chars) AS BIGINT) AS total FROM scored GROUP BY model)
SELECT model, errors, total, errors / total AS rate, round((errors / total - avg(errors / total) OVER ()) / avg(errors / total) OVER (), 8) AS deviation, abs((errors / total - avg(errors / total) OVER ()) / avg(errors / total) OVER ()) > 0.15 AS flagged FROM m""",
)
def a14_micro_average(spark, d):
    rows = evaluation.micro_average(_scored(spark, d), F.col("distance"), F.col("gt_chars"))
    return rows.withColumn("deviation", F.round("deviation", 8))


@query(
    "a20_pooled",
    f"""WITH {sql.SCORED} SELECT model, count(*) AS comparisons, count(DISTINCT page_id) AS pages, CAST(sum(distance) AS BIGINT) AS errors FROM scored GROUP BY model""",
)
def a20_pooled(spark, d):
    return _scored(spark, d).groupBy("model").agg(F.count("*").alias("comparisons"), F.countDistinct("page_id").alias("pages"), F.sum("distance").alias("errors"))


@query(
    "a16_marker_counts",
    "WITH f AS (SELECT replace(gt_text, chr(10), '') AS t FROM gt_page), c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS marker, sum(len(regexp_extract_all(t, '(?i){p}'))) AS n FROM f" for n, p in corpus.MARKER_PATTERNS.items())
    + ") SELECT marker, CAST(n AS BIGINT) AS n FROM c WHERE n > 0",
)
def a16_marker_counts(spark, d):
    return corpus.marker_counts(table(spark, d, "gt_page"), "gt_text")


_FEATURES = {**corpus.ORTHOGRAPHY, **{f"double_{x}": x for x in corpus.DOUBLE_LETTERS}}


ORTHOGRAPHY_SQL = (
    f"WITH w AS (SELECT lower(unnest(regexp_extract_all({sql.reconstructed('gt_text')}, '[a-záéíóúçñA-ZÁÉÍÓÚÇÑ]+'))) AS word FROM gt_page), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), l AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, word, n FROM c WHERE regexp_matches(word, '{p}')" for n, p in _FEATURES.items())
    + """) SELECT feature, CAST(sum(CASE WHEN feature = 'c_cedilla' THEN n * (length(word) - length(replace(word, 'ç', ''))) ELSE n END) AS BIGINT) AS n, count(*) AS unique_words,
  list_sort(list(word))[1:CASE WHEN feature LIKE 'double_%' OR feature LIKE 'h_%' THEN 15 ELSE 25 END] AS examples FROM l GROUP BY feature"""
)


@query("a17_orthography", ORTHOGRAPHY_SQL)
def a17_orthography(spark, d):
    return corpus.orthography(table(spark, d, "gt_page"), "gt_text")


DIMENSIONS = ["dataset", "siglo", "letra_normalized", "provincia", "tipologia"]


@query(
    "a18_counts",
    "WITH l AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value FROM manifest" for x in DIMENSIONS)
    + "), c AS (SELECT dimension, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)"
    " SELECT dimension, value, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INT) AS rank FROM c QUALIFY rank <= 10",
)
def a18_counts(spark, d):
    return corpus.counts_by_dimension(table(spark, d, "manifest"), DIMENSIONS)


# --- joins and sets --------------------------------------------------------------------------------------------


@query("j2_common_pages", "WITH m AS (SELECT count(DISTINCT model) AS n FROM hypothesis) SELECT page_id FROM hypothesis WHERE page_id IS NOT NULL GROUP BY page_id HAVING count(DISTINCT model) = (SELECT n FROM m)")
def j2_common_pages(spark, d):
    return evaluation.common_pages(table(spark, d, "hypothesis").where("page_id IS NOT NULL"))


def _page_distances(spark, d):
    return _scored(spark, d).groupBy("page_id", "model").agg(F.min("distance").alias("distance"))


_PAGE_DISTANCES = f"{sql.SCORED}, dist AS (SELECT page_id, model, min(distance) AS distance FROM scored GROUP BY page_id, model)"
_MODEL_PAIRS = f"""{_PAGE_DISTANCES},
mp AS (SELECT a.page_id, a.model AS model_a, b.model AS model_b, a.distance AS value_a, b.distance AS value_b FROM dist a JOIN dist b ON a.page_id = b.page_id AND a.model < b.model)"""


@query("j3_model_pairs", f"WITH {_MODEL_PAIRS} SELECT page_id, model_a, model_b, CAST(value_a AS INT) AS value_a, CAST(value_b AS INT) AS value_b FROM mp")
def j3_model_pairs(spark, d):
    return evaluation.model_pairs(_page_distances(spark, d), "distance")


@query(
    "j5_page_attributes",
    f"WITH {sql.PAGES} SELECT hyp_id, h.page_id, dataset, doc_id FROM hypothesis h LEFT JOIN pages USING (page_id)",
)
def j5_page_attributes(spark, d):
    return evaluation.with_pages(table(spark, d, "hypothesis"), table(spark, d, "manifest")).select("hyp_id", "page_id", "dataset", "doc_id")


@query("j10_uncatalogued", "SELECT hyp_id FROM hypothesis h WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.page_id = h.page_id)")
def j10_uncatalogued(spark, d):
    return evaluation.exclude_pages(table(spark, d, "hypothesis"), table(spark, d, "manifest").select("page_id").distinct()).select("hyp_id")


@query(
    "j11_combined",
    f"""WITH {sql.SCORED} SELECT model, CAST(sum(distance) FILTER (edition = 'paleographic') AS BIGINT) AS paleographic, CAST(sum(distance) FILTER (edition = 'critical') AS BIGINT) AS critical,
  CAST(sum(distance) FILTER (edition = 'editorial') AS BIGINT) AS editorial FROM scored GROUP BY model""",
)
def j11_combined(spark, d):
    return _scored(spark, d).groupBy("model").pivot("edition", ["paleographic", "critical", "editorial"]).agg(F.sum("distance"))


@query("u2_shared_pages", "SELECT page_id FROM gt_page WHERE page_id IS NOT NULL INTERSECT SELECT page_id FROM hypothesis")
def u2_shared_pages(spark, d):
    return table(spark, d, "gt_page").where("page_id IS NOT NULL").select("page_id").intersect(table(spark, d, "hypothesis").select("page_id"))


@query("u3_pages_without_text", "SELECT DISTINCT page_id FROM manifest WHERE page_id IS NOT NULL EXCEPT SELECT page_id FROM gt_page")
def u3_pages_without_text(spark, d):
    return table(spark, d, "manifest").where("page_id IS NOT NULL").select("page_id").exceptAll(table(spark, d, "gt_page").select("page_id")).distinct().join(
        table(spark, d, "gt_page").select("page_id").distinct(), "page_id", "left_anti"
    )


@query("k8_to_do", "SELECT DISTINCT m.page_id FROM manifest m WHERE m.page_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hypothesis h WHERE h.page_id = m.page_id AND h.hyp_text <> '')")
def k8_to_do(spark, d):
    rows = table(spark, d, "manifest").where("page_id IS NOT NULL").select("page_id").distinct()
    return quality.not_done(rows, table(spark, d, "hypothesis").where("hyp_text <> ''"), ["page_id"])


# --- statistics ------------------------------------------------------------------------------------------------


@query(
    "t2_signed_ranks",
    f"""WITH {_MODEL_PAIRS}, df AS (SELECT model_a, model_b, value_a - value_b AS d FROM mp WHERE value_a <> value_b),
rk AS (SELECT model_a, model_b, d, rank() OVER w + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2 AS r FROM df WINDOW w AS (PARTITION BY model_a, model_b ORDER BY abs(d)))
SELECT model_a, model_b, count(*) AS n, CAST(least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS DOUBLE) AS w FROM rk GROUP BY model_a, model_b""",
)
def t2_signed_ranks(spark, d):
    rows = stats.signed_rank_statistic(evaluation.model_pairs(_page_distances(spark, d), "distance"))
    return rows.select("model_a", "model_b", "n", F.col("w").cast("double").alias("w"))


def _tests(spark, d):
    rates = evaluation.per_page_and_model(_rates(spark, d))
    return stats.wilcoxon(evaluation.model_pairs(rates))


@query("t2_wilcoxon", f"WITH {sql.TESTS} SELECT model_a, model_b, n, statistic, p_value FROM tested")
def t2_wilcoxon(spark, d):
    return _tests(spark, d).withColumn("p_value", F.round("p_value", 6))


@query("t4_significance", f"WITH {sql.TESTS} SELECT model_a, model_b, n, statistic, p_value, round(p_adjusted, 9) AS p_adjusted, p_adjusted < 0.05 AS significant FROM corrected")
def t4_significance(spark, d):
    rates = evaluation.per_page_and_model(_rates(spark, d))
    return stats.pairwise_significance(rates, evaluation.model_pairs(rates)).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("t1_bootstrap")
def t1_bootstrap(spark, d):
    return stats.bootstrap_intervals(evaluation.per_page_and_model(_rates(spark, d)))


@query("t3_holm", f"WITH {sql.TESTS} SELECT model_a, model_b, p_value, round(p_adjusted, 9) AS p_adjusted, p_adjusted < 0.05 AS significant FROM corrected")
def t3_holm(spark, d):
    """The correction over the p-values of the signed-rank tests."""
    tests = _tests(spark, d).select("model_a", "model_b", F.round("p_value", 6).alias("p_value"))
    return stats.holm(tests).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("t5_gate", f"WITH m AS (SELECT count(DISTINCT model) AS models FROM hypothesis), c AS (SELECT page_id FROM hypothesis WHERE page_id IS NOT NULL GROUP BY page_id HAVING count(DISTINCT model) = (SELECT models FROM m)) SELECT models, (SELECT count(*) FROM c) AS pages, models >= 2 AND (SELECT count(*) FROM c) >= 5 AS enough FROM m")
def t5_gate(spark, d):
    rows = table(spark, d, "hypothesis")
    return stats.enough_to_compare(rows, evaluation.common_pages(rows.where("page_id IS NOT NULL")))


# --- errors ----------------------------------------------------------------------------------------------------


def _spans(spark, d):
    return errors.spans(_compared(spark, d, "strict"), KEYS)


def _counted(spark, d, words=False):
    return errors.counted_spans(_compared(spark, d, "strict"), ["model"], words)


@query("e4_error_classes")
def e4_error_classes(spark, d):
    return errors.error_classes(_counted(spark, d), ["model"])


@query("a13_confusions")
def a13_confusions(spark, d):
    return errors.confusions(_counted(spark, d), ["model"])


@query("e7_persistent")
def e7_persistent(spark, d):
    return errors.persistent_confusions(errors.confusions(_counted(spark, d), ["model"]))


@query("e7_versions")
def e7_versions(spark, d):
    """Classes of errors per model against the characters of its pages."""
    totals = _compared(spark, d, "strict").groupBy("model").agg(F.sum(F.length(text.for_error_analysis(F.col("ref")))).alias("gt_chars"))
    return errors.version_report(errors.error_classes(_counted(spark, d), ["model"]), totals)


@query("w4_garbled")
def w4_garbled(spark, d):
    return errors.garbled_runs(_spans(spark, d), KEYS)


@query("e5_word_errors")
def e5_word_errors(spark, d):
    return errors.word_errors(_counted(spark, d, words=True), ["model"])


@query("e6_line_diff")
def e6_line_diff(spark, d):
    return errors.line_diff(_raw_lines(spark, d), KEYS)


_E2_PAIRS = """SELECT r, h FROM (SELECT unnest(string_split('aáàäeéoóuvijxsſbzçcñnqQmrtdlfhAEÑ&.,-7 ', '')) AS r), (SELECT unnest(string_split('aáàäeéoóuvijxsſbzçcñnqQmrtdlfhAEÑ&.,-7 ', '')) AS h)"""
_CHARS = "aáàäeéoóuvijxsſbzçcñnqQmrtdlfhAEÑ&.,-7 "


def _in(names: str) -> str:
    both = [p for x in names.split() for p in (x, x[::-1])]
    return ", ".join(f"'{p}'" for p in both)


@query(
    "e2_substitution_classes",
    f"""WITH p AS ({_E2_PAIRS}), l AS (SELECT r AS ref_char, h AS hyp_char, lower(r) AS r, lower(h) AS h, strip_accents(lower(r)) AS rb, strip_accents(lower(h)) AS hb FROM p)
SELECT ref_char, hyp_char, CASE WHEN r = h THEN 'case' WHEN rb = hb THEN 'diacritical' WHEN (r = 'ç' OR h = 'ç') AND (rb IN ('c', 'z') OR hb IN ('c', 'z')) THEN 'cedilla'
  WHEN r || h IN ({_in("uv ij xj sſ bv")}) THEN 'paleographic_alternation' WHEN r = 'q' AND h = 'c' THEN 'modernization' WHEN r = '&' OR h = '&' THEN 'abbreviation_marker'
  WHEN r = ' ' OR h = ' ' THEN 'word_boundary' WHEN regexp_matches(r, '[^\\p{{L}}\\p{{N}}]') OR regexp_matches(h, '[^\\p{{L}}\\p{{N}}]') THEN 'punctuation'
  WHEN r || h IN ({_in("eo ao ae nu nr mn ce tr do li lt fs hb db")}) THEN 'visual_confusion' ELSE 'other_substitution' END AS class FROM l""",
)
def e2_substitution_classes(spark, d):
    """The taxonomy over every two of some forty characters."""
    chars = spark.range(1).select(F.explode(F.split(F.lit(_CHARS), "")).alias("ref_char"))
    both = chars.where("ref_char <> ''").withColumn("hyp_char", F.explode(F.split(F.lit(_CHARS), ""))).where("hyp_char <> ''")
    return both.withColumn("class", errors.substitution_class(F.col("ref_char"), F.col("hyp_char")))


# --- vocabulary ------------------------------------------------------------------------------------------------


def _vocab(spark, d):
    return vocabulary.vocabulary(table(spark, d, "vocab"))


def _found(spark, d):
    return vocabulary.tokens(table(spark, d, "gt_page"), "gt_id", "gt_text")


_TOKENS = "toks AS (SELECT gt_id, unnest(regexp_extract_all(gt_text, '[a-záéíóúñçüA-ZÁÉÍÓÚÑÇÜ]+')) AS original FROM gt_page), words AS (SELECT gt_id, lower(original) AS word FROM toks), forms AS (SELECT DISTINCT lower(form) AS form FROM vocab WHERE form <> '')"
_UNKNOWN = f"{_TOKENS}, unknown AS (SELECT gt_id, word FROM words WHERE length(word) >= 3 AND word NOT IN (SELECT form FROM forms))"


@query("s7_vocabulary", "SELECT DISTINCT lower(form) AS form FROM vocab WHERE form IS NOT NULL AND form <> ''")
def s7_vocabulary(spark, d):
    return _vocab(spark, d)


@query("v1_tokens", f"WITH {_TOKENS} SELECT word, count(*) AS n FROM words GROUP BY word")
def v1_tokens(spark, d):
    return _found(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "v1_token_places",
    """WITH t AS (SELECT gt_id, regexp_extract_all(gt_text, '[a-záéíóúñçüA-ZÁÉÍÓÚÑÇÜ]+') AS words, string_split_regex(gt_text, '[a-záéíóúñçüA-ZÁÉÍÓÚÑÇÜ]+') AS gaps FROM gt_page),
u AS (SELECT gt_id, unnest(range(0, len(words))) AS place, words, gaps FROM t),
w AS (SELECT gt_id, place, words[place + 1] AS original, list_sum(list_transform(gaps[1:place + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(words[1:place], lambda g: length(g))), 0) AS start FROM u)
SELECT gt_id, CAST(place AS INT) AS place, original, CAST(start AS INT) AS start, CAST(start + length(original) AS INT) AS "end", lower(original) AS word FROM w""",
)
def v1_token_places(spark, d):
    return vocabulary.tokens_with_places(table(spark, d, "gt_page"), "gt_id", "gt_text")


@query("j6_unknown_words", f"WITH {_UNKNOWN} SELECT word, count(*) AS n, count(DISTINCT gt_id) AS texts FROM unknown GROUP BY word")
def j6_unknown_words(spark, d):
    return vocabulary.unknown_words(_found(spark, d), _vocab(spark, d)).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("gt_id").alias("texts"))


_VARIED = " OR ".join((
    "substr(word, 1, 2) = substr(form, 1, 2)",
    "substr(word, 2, 1) || substr(word, 1, 1) = substr(form, 1, 2)",
    f"(length(form) >= 2 AND substr(word, 2, 1) = substr(form, 2, 1) AND strpos('{vocabulary.ALPHABET}', substr(form, 1, 1)) > 0)",
    f"(length(form) >= 2 AND substr(word, 1, 1) = substr(form, 1, 1) AND strpos('{vocabulary.ALPHABET}', substr(form, 2, 1)) > 0)",
))


@query(
    "v3_candidates",
    f"""WITH {_UNKNOWN}, asked AS (SELECT DISTINCT word FROM unknown), near AS (
  SELECT word, form AS candidate, levenshtein({sql.narrow("word")}, {sql.narrow("form")}) AS distance FROM asked JOIN forms ON abs(length(word) - length(form)) <= 3 AND ({_VARIED}))
SELECT word, candidate, CAST(distance AS INT) AS distance, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, candidate) AS INT) AS rank FROM near WHERE distance <= 3 QUALIFY rank <= 3""",
)
def v3_candidates(spark, d):
    return vocabulary.candidates(vocabulary.unknown_words(_found(spark, d), _vocab(spark, d)), _vocab(spark, d))


@query(
    "v4_compounds",
    f"""WITH {_UNKNOWN}, asked AS (SELECT DISTINCT word, length(word) AS n FROM unknown),
c AS (SELECT word, n, unnest(range(2, n - 1)) AS i FROM asked WHERE n >= 4), l AS (SELECT word, n, i, substr(word, 1, i) AS a FROM c WHERE substr(word, 1, i) IN (SELECT form FROM forms)),
two AS (SELECT word, arg_min([a, substr(word, i + 1)], i) AS parts FROM l WHERE substr(word, i + 1) IN (SELECT form FROM forms) GROUP BY word),
m AS (SELECT word, n, i, a, unnest(range(i + 2, n - 1)) AS j FROM l WHERE n - i >= 4 AND word NOT IN (SELECT word FROM two)),
three AS (SELECT word, arg_min([a, substr(word, i + 1, j - i), substr(word, j + 1)], i * 1000 + j) AS parts FROM m
  WHERE substr(word, i + 1, j - i) IN (SELECT form FROM forms) AND substr(word, j + 1) IN (SELECT form FROM forms) GROUP BY word)
SELECT * FROM two UNION ALL SELECT * FROM three""",
)
def v4_compounds(spark, d):
    return vocabulary.compounds(vocabulary.unknown_words(_found(spark, d), _vocab(spark, d)), _vocab(spark, d))


# Abbreviations of the transcriptions and what they stand for.
ABBREVIATIONS = {"q": "que", "dho": "dicho", "dha": "dicha", "nro": "nuestro", "xpo": "cristo", "mrs": "maravedís", "scriº": "escriuano", "v": "u"}


def _abbrevs(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(ABBREVIATIONS.items())]
    return vocabulary.abbreviations(spark.createDataFrame(rows, "id int, abbreviated string, expanded string"))


@query(
    "v5_expansions",
    f"""WITH {_UNKNOWN}, abbr(a, e) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ABBREVIATIONS.items())}), asked AS (SELECT DISTINCT word FROM unknown),
hit AS (SELECT word, a, CASE WHEN a = word THEN e ELSE substr(word, 1, strpos(word, a) - 1) || e || substr(word, strpos(word, a) + length(a)) END AS candidate, CASE WHEN a = word THEN 0 ELSE 1 END AS o
  FROM asked JOIN abbr ON contains(word, a)),
once AS (SELECT word, candidate, min(o || a) AS k FROM hit WHERE candidate IN (SELECT form FROM forms) GROUP BY word, candidate)
SELECT word, list(candidate ORDER BY k) AS expansions FROM once GROUP BY word""",
)
def v5_expansions(spark, d):
    return vocabulary.expansions(vocabulary.unknown_words(_found(spark, d), _vocab(spark, d)), _vocab(spark, d), _abbrevs(spark))


def _candidates(spark, d):
    found = vocabulary.tokens_with_places(table(spark, d, "gt_page"), "gt_id", "gt_text")
    return vocabulary.candidates_table(found, _vocab(spark, d), _abbrevs(spark))


_PLACES_SQL, _NEAR_SQL, _COMPOUNDS_SQL, _EXPANSIONS_SQL = (sql_of(n) for n in ("v1_token_places", "v3_candidates", "v4_compounds", "v5_expansions"))
_LOOKED_UP = f"""places AS ({_PLACES_SQL}), known AS (SELECT DISTINCT lower(form) AS form FROM vocab WHERE form <> ''),
near AS (SELECT word, list(candidate || ' (d=' || distance || ')' ORDER BY rank) AS edit_candidates, arg_min(candidate, rank) AS closest FROM ({_NEAR_SQL}) GROUP BY word),
looked AS (SELECT p.*, edit_candidates, closest, c.parts AS compound, expansions FROM places p LEFT JOIN near USING (word) LEFT JOIN ({_COMPOUNDS_SQL}) c USING (word) LEFT JOIN ({_EXPANSIONS_SQL}) x USING (word)
  WHERE length(p.word) >= 3 AND p.word NOT IN (SELECT form FROM known))"""


@query("v6_candidates_table", f'WITH {_LOOKED_UP} SELECT gt_id, place, original, start, "end", word, edit_candidates, compound, expansions FROM looked')
def v6_candidates_table(spark, d):
    rows = _candidates(spark, d)
    shown = F.transform("edit_candidates", lambda c: F.format_string("%s (d=%d)", c["candidate"], c["distance"]))
    return rows.withColumn("edit_candidates", shown).select("gt_id", "place", "original", "start", "end", "word", "edit_candidates", "compound", "expansions")


@query(
    "v7_prompts",
    f"""WITH {_LOOKED_UP}, lines AS (SELECT gt_id, start, row_number() OVER (PARTITION BY gt_id ORDER BY start) AS k, chr(39) || word || chr(39) || ' [' || array_to_string(list_concat(coalesce(edit_candidates, []),
  CASE WHEN compound IS NOT NULL THEN ['split: ' || array_to_string(compound, ' + ')] ELSE [] END, CASE WHEN expansions IS NOT NULL THEN ['abbrev: ' || array_to_string(expansions, ', ')] ELSE [] END), ', ') || ']' AS line FROM looked)
SELECT gt_id, string_agg(k || '. ' || line, chr(10) ORDER BY k) AS prompt FROM lines GROUP BY gt_id""",
)
def v7_prompts(spark, d):
    return vocabulary.correction_prompt(_candidates(spark, d), "gt_id")


@query(
    "f15_corrected",
    f"""WITH {_LOOKED_UP}, t AS (SELECT gt_id, string_split_regex(gt_text, '[a-záéíóúñçüA-ZÁÉÍÓÚÑÇÜ]+') AS gaps FROM gt_page WHERE gt_text IS NOT NULL),
w AS (SELECT p.gt_id, string_agg(gaps[p.place + 1] || coalesce(closest, p.original), '' ORDER BY p.place) AS body FROM places p JOIN t USING (gt_id) LEFT JOIN looked l ON l.gt_id = p.gt_id AND l.place = p.place GROUP BY p.gt_id)
SELECT gt_id, coalesce(body, '') || coalesce(gaps[-1], '') AS text FROM t LEFT JOIN w USING (gt_id)""",
)
def f15_corrected(spark, d):
    chosen = vocabulary.default_choice(_candidates(spark, d))
    return vocabulary.corrected_texts(table(spark, d, "gt_page").where("gt_text IS NOT NULL").select("gt_id", "gt_text"), chosen, "gt_id", "gt_text")


@query(
    "v9_base_words",
    f"WITH {_TOKENS}, w AS (SELECT DISTINCT word FROM words) SELECT word, CASE "
    + " ".join(f"WHEN starts_with(word, '{p}') AND length(word) >= {len(p) + 2} THEN substr(word, {len(p) + 1})" for p in vocabulary.RUN_IN_PREFIXES)
    + " ELSE word END AS base FROM w",
)
def v9_base_words(spark, d):
    return _found(spark, d).select("word").distinct().withColumn("base", vocabulary.base_word(F.col("word")))


@query("v8_abbreviations")
def v8_abbreviations(spark, d):
    return vocabulary.abbreviation_instances(table(spark, d, "gt_page"), "gt_id", "gt_text")


@query("a15_abbreviation_groups")
def a15_abbreviation_groups(spark, d):
    return vocabulary.abbreviation_groups(vocabulary.abbreviation_instances(table(spark, d, "gt_page"), "gt_id", "gt_text"), "gt_id")


@query("n19_reconstructed", f"SELECT gt_id, {sql.reconstructed('gt_text')} AS text FROM gt_page")
def n19_reconstructed(spark, d):
    return table(spark, d, "gt_page").select("gt_id", corpus.reconstructed(F.col("gt_text")).alias("text"))


# --- editions and sources --------------------------------------------------------------------------------------


_EDITION_LINE = (
    (r"(?i)\s+mano\s+\d+\s*:\s*", ": "),
    (r"(?i)\[mano\s+\d+\s*:\s*", ""),
    (r"(?i)\[firmas\s*:", "[firma:"),
    (r"(?i)\[rubrica\]", "[rúbrica]"),
    (r"(?i)\(tachado\s+(.*?)\)", r"[tachado: \1]"),
    (r"(?i)\[lat\.\s*:(.*?)\]", r"\1"),
    (r"(?i)\[blanco\s+[^\]]+\]", "[blanco]"),
    (r"\[\*[\s*]*\*\]", "[ilegible]"),
    (r"\*{3,}", "[ilegible]"),
    (r"[≤|]", ""),
    (r"\s*/\s*$", ""),
)
_NUMBERS_CUT = sql.replace("gt_text", (r"(?m)^\{h\.\s*\w+\}.*$", ""), (rf"(?m){sql.S_BUT_LF}+$", ""), (r"(?m)^\s*\d+$", "@CUT@"), (r"\n", ""))
_CLOSED = sql.replace(r"CASE WHEN length(t) - length(replace(t, ']', '')) > length(t) - length(replace(t, '[', '')) THEN regexp_replace(t, '\](\s*)$', '\1') ELSE t END", ("  +", " "))


@query(
    "n8_editions",
    f"""WITH x AS (SELECT gt_id, string_split({_NUMBERS_CUT}, '@CUT@') AS x FROM gt_page WHERE gt_text IS NOT NULL), l AS (SELECT gt_id, unnest(range(1, len(x) + 1)) AS i, x FROM x),
c AS (SELECT gt_id, i, {sql.replace("x[i]", *_EDITION_LINE)} AS t FROM l), s AS (SELECT gt_id, i, {sql.strip(_CLOSED)} AS t FROM c),
j AS (SELECT gt_id, string_agg(t, chr(10) ORDER BY i) FILTER (t <> '') AS text FROM s GROUP BY gt_id)
SELECT g.gt_id, CASE WHEN g.gt_text IS NOT NULL THEN coalesce(text, '') END AS text FROM gt_page g LEFT JOIN j USING (gt_id)""",
)
def n8_editions(spark, d):
    return table(spark, d, "gt_page").select("gt_id", editions.parse_edition(F.col("gt_text")).alias("text"))


_MD = "regexp_replace(regexp_replace(CASE WHEN starts_with(md, '---') THEN regexp_replace(md, '(?s)\\A---.*?---', '') ELSE md END, '^\\s+', ''), '\\s+$', '')"
_FOLIO = r"(?i)\[\s*_?(?:Fol\.?|Folio)\s+(\d+)\s*,?\s*(recto|vuelto|vuelta|r|v)_?\s*\]"


FOLIO_PAGES_SQL = f"""WITH b AS (SELECT doc_id, CASE WHEN starts_with(md, '---') THEN {_MD} ELSE md END AS t FROM transcripcion WHERE md IS NOT NULL),
p AS (SELECT doc_id, string_split_regex(t, '{_FOLIO}') AS parts, regexp_extract_all(t, '{_FOLIO}', 1) AS nums, regexp_extract_all(t, '{_FOLIO}', 2) AS sides FROM b),
r AS (SELECT doc_id, unnest(range(0, len(parts))) AS i, parts, nums, sides FROM p),
q AS (SELECT doc_id, i, CASE WHEN i = 0 THEN 1 ELSE (CAST(nums[i] AS INT) - 1) * 2 + CASE WHEN lower(sides[i]) IN ('recto', 'r') THEN 1 ELSE 2 END END AS page_no, parts[i + 1] AS page_text FROM r)
SELECT doc_id, CAST(page_no AS INT) AS page_no, arg_min(page_text, i) AS page_text FROM q GROUP BY doc_id, page_no"""


@query("n12_folio_pages", FOLIO_PAGES_SQL)
def n12_folio_pages(spark, d):
    return editions.folio_pages(table(spark, d, "transcripcion"))


@query("n17_transcriptions")
def n17_transcriptions(spark, d):
    last = editions.last_image(F.col("md"), F.col("doc_id"))
    pages = table(spark, d, "transcripcion").select("doc_id", "md", F.explode(F.sequence(F.lit(1), last)).alias("page"))
    return pages.select("doc_id", "page", text.normalize_unicode(editions.parse_transcription(F.col("md"), F.col("page"), F.col("doc_id"))).alias("text"))


@query("n14_footnotes")
def n14_footnotes(spark, d):
    body = editions.without_front_matter(F.col("md"))
    return table(spark, d, "transcripcion").select("doc_id", F.explode(editions.footnotes(body)).alias("n")).select("doc_id", "n.*")


_BODY = f"CASE WHEN starts_with(md, '---') THEN {_MD} ELSE md END"
_KNOWN = " ".join(f"WHEN doc_id = '{k}' THEN {v}" for k, v in editions.KNOWN_OFFSETS.items())


@query(
    "n13_offsets",
    f"""WITH b AS (SELECT doc_id, {_BODY} AS t FROM transcripcion), p AS (SELECT doc_id, t, string_split_regex(t, '{_FOLIO}')[1] AS first, regexp_extract_all(t, '{_FOLIO}', 1) AS nums, regexp_extract_all(t, '{_FOLIO}', 2) AS sides FROM b)
SELECT doc_id, CAST(CASE {_KNOWN} WHEN len(nums) > 0 AND regexp_matches(first, '(?i)\\[\\s*_?Cubierta_?\\s*\\]') THEN 1
  WHEN len(nums) > 0 AND CAST(nums[1] AS INT) = 1 AND lower(sides[1]) NOT IN ('recto', 'r') THEN 0 WHEN len(nums) > 0 AND length(first) > 100 AND length({sql.strip("first")}) > {editions.LEAST_CHARS} THEN 1 ELSE 0 END AS INT) AS images_before FROM p""",
)
def n13_offsets(spark, d):
    return table(spark, d, "transcripcion").select("doc_id", editions.page_offset(editions.without_front_matter(F.col("md")), F.col("doc_id")).alias("images_before"))


@query(
    "s15_front_matter",
    """WITH f AS (SELECT tr_id, regexp_extract(md, '(?s)\\A---\\n(.+?)\\n---', 1) AS f FROM transcripcion)
SELECT tr_id, nullif(regexp_extract(f, '(?m)^document_date: "?([^"\\n]*)"?$', 1), '') AS document_date, nullif(regexp_extract(f, '(?m)^archive: "?([^"\\n]*)"?$', 1), '') AS archive FROM f""",
)
def s15_front_matter(spark, d):
    fields = readers.front_matter(F.col("md"))
    return table(spark, d, "transcripcion").select("tr_id", fields["document_date"].alias("document_date"), fields["archive"].alias("archive"))


_VALID = f"length({sql.collapse(sql.replace('page_text', (chr(92) + '[.*?' + chr(92) + ']', '')))}) >= 50"


@query("f7_valid_pages", f"SELECT doc_id, page_no FROM ({FOLIO_PAGES_SQL}) WHERE {_VALID}")
def f7_valid_pages(spark, d):
    return sampling.valid_pages(table(spark, d, "transcripcion"))


@query("s4_eligible", "SELECT entry_id FROM document_entry WHERE downloaded AND len(facsimile_pages) > 0")
def s4_eligible(spark, d):
    return sampling.eligible(table(spark, d, "document_entry")).select("entry_id")


@query("s14_inventory", "SELECT entry_id, regexp_extract(doc_id, '(CODEA-\\d+)', 1) AS doc FROM document_entry WHERE contains(lower(letra), 'procesal') AND regexp_extract(doc_id, '(CODEA-\\d+)', 1) <> ''")
def s14_inventory(spark, d):
    rows = table(spark, d, "document_entry").withColumnRenamed("doc_id", "raw_id")
    return readers.inventory(rows).select("entry_id", F.col("doc_id").alias("doc"))


@query("f3_procesal", "SELECT entry_id FROM document_entry WHERE contains(lower(letra), 'procesal') OR contains(lower(letra), 'procesada')")
def f3_procesal(spark, d):
    return quality.procesal(table(spark, d, "document_entry")).select("entry_id")


@query(
    "s18_facsimiles",
    """WITH p AS (SELECT entry_id, i AS place, CAST(i // 2 + 1 AS VARCHAR) || CASE WHEN i % 2 = 0 THEN 'r' ELSE 'v' END AS page, facsimile_pages FROM document_entry, range(0, 40) t(i) WHERE facsimile_pages IS NOT NULL),
f AS (SELECT entry_id, place, page, list_contains(facsimile_pages, page) AS found FROM p),
m AS (SELECT *, sum(CASE WHEN found THEN 0 ELSE 1 END) OVER (PARTITION BY entry_id ORDER BY place ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS missed FROM f),
e AS (SELECT *, max(CASE WHEN missed = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id ORDER BY place) AS ended FROM m)
SELECT entry_id, page, CAST(place AS INT) AS place FROM e WHERE found AND ended = 0""",
)
def s18_facsimiles(spark, d):
    """The pages that a probe with four misses allowed would find, of those that are listed."""
    i = F.col("place")
    rows = table(spark, d, "document_entry").where("facsimile_pages IS NOT NULL").select(F.col("entry_id").alias("doc_id"), "facsimile_pages", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("place"))
    page = F.concat((F.floor(i / 2) + 1).cast("string"), F.when(i % 2 == 0, "r").otherwise("v"))
    found = readers.facsimiles_found(rows.select("doc_id", "place", page.alias("page"), F.array_contains("facsimile_pages", page).alias("found")))
    return found.select(F.col("doc_id").alias("entry_id"), "page", "place")


_SEEN = "seen AS (SELECT doc_id, list_sort(list(DISTINCT page)) AS pages FROM manifest WHERE doc_id IS NOT NULL AND page IS NOT NULL GROUP BY doc_id)"


def _with_pages_seen(spark, d):
    """Entries with the pages that are catalogued of their document."""
    seen = table(spark, d, "manifest").where("doc_id IS NOT NULL AND page IS NOT NULL").groupBy("doc_id").agg(F.collect_set("page").alias("pages"))
    return table(spark, d, "document_entry").join(seen, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<string>")))


@query(
    "f8_violations",
    f"""WITH {_SEEN}, e AS (SELECT d.*, coalesce(pages, []) AS pages FROM document_entry d LEFT JOIN seen USING (doc_id))
{" UNION ALL ".join(f"SELECT entry_id, 'metadata missing {name}' AS rule FROM e WHERE {column} IS NULL" for name, column in (("doc_id", "doc_id"), ("date", "fecha"), ("archive", "archivo"), ("letra", "letra"), ("facsimile_pages", "facsimile_pages")))}
UNION ALL SELECT entry_id, 'facsimile_pages mismatch' FROM e WHERE list_sort(coalesce(facsimile_pages, [])) <> pages""",
)
def f8_violations(spark, d):
    """Fields that metadata must have, what the ground truth may be, and listed pages against those that are there."""
    has = F.size(F.coalesce("facsimile_pages", F.array().cast("array<string>"))) > 0
    kind, form = F.when(has, "paleographic+critical"), F.when(has, "per-page-txt")
    fields = {"doc_id": "doc_id", "date": "fecha", "archive": "archivo", "letra": "letra", "facsimile_pages": "facsimile_pages"}
    rules = quality.metadata_rules({n: F.col(c) for n, c in fields.items()}, has, kind, form, F.col("facsimile_pages"), F.col("pages"))
    return quality.violations(_with_pages_seen(spark, d), "entry_id", rules)


@query("u5_same_pages", f"WITH {_SEEN} SELECT entry_id, list_sort(coalesce(facsimile_pages, [])) = coalesce(pages, []) AS same FROM document_entry LEFT JOIN seen USING (doc_id)")
def u5_same_pages(spark, d):
    listed = F.coalesce("facsimile_pages", F.array().cast("array<string>"))
    return _with_pages_seen(spark, d).select("entry_id", quality.same_set(listed, F.col("pages")).alias("same"))


_EXTRA = ["provincia", "poblacion", "tipologia", "ambito", "soporte", "copista", "signatura"]


@query(
    "f9_metadata",
    "WITH e AS (SELECT *, len(facsimile_pages) > 0 AS has FROM document_entry) SELECT entry_id, doc_id, fecha AS date, archivo AS archive, letra, facsimile_pages, "
    "CASE WHEN has THEN '{\"available\":true,\"type\":\"paleographic+critical\",\"format\":\"per-page-txt\"}' WHEN NOT has THEN '{\"available\":false}' ELSE '{}' END AS ground_truth, "
    + "'{' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} <> '' THEN '\"{c}\":' || to_json({c}) END" for c in _EXTRA) + "], lambda x: x IS NOT NULL), ',') || '}' AS extra FROM e",
)
def f9_metadata(spark, d):
    rows = table(spark, d, "document_entry")
    core = {"entry_id": F.col("entry_id"), "doc_id": F.col("doc_id"), "date": F.col("fecha"), "archive": F.col("archivo"), "letra": F.col("letra"), "facsimile_pages": F.col("facsimile_pages")}
    extra = _EXTRA
    has = F.size("facsimile_pages") > 0
    out = quality.reshaped(rows, core, has, F.when(has, "paleographic+critical"), F.when(has, "per-page-txt"), extra)
    return out.withColumn("extra", F.to_json("extra")).withColumn("ground_truth", F.to_json("ground_truth"))


@query("k10_page_counts", "SELECT entry_id, CAST(len(facsimile_pages) AS INT) AS facsimile_count FROM document_entry")
def k10_page_counts(spark, d):
    rows = table(spark, d, "document_entry").select(F.col("entry_id").alias("doc_id"), "facsimile_pages")
    counted = rows.where("facsimile_pages IS NOT NULL").select("doc_id", F.size("facsimile_pages").alias("facsimile_count"))
    return quality.with_facsimile_count(rows, counted).select(F.col("doc_id").alias("entry_id"), "facsimile_count")


@query(
    "k3_markdown",
    f"""WITH {sql.SCORED}, m AS (SELECT model, count(*) AS n_pages, avg({RATE_SQL}) AS mean, quantile_cont({RATE_SQL}, 0.5) AS median FROM scored GROUP BY model),
r AS (SELECT *, row_number() OVER (ORDER BY round(mean, 4), model) AS rank FROM m)
SELECT CAST(rank AS INT) AS line, '| ' || rank || ' | ' || model || ' | ' || n_pages || ' | ' || printf('%.4f', mean) || ' | ' || printf('%.4f', median) || ' |' AS text FROM r
UNION ALL SELECT -2, '| rank | model | n_pages | cer_mean | cer_median |' UNION ALL SELECT -1, '|---|---|---|---|---|'""",
)
def k3_markdown(spark, d):
    from escriba.sources.sinks import markdown_rows

    return markdown_rows(evaluation.ranking(evaluation.model_summary(_rates(spark, d))), ["rank", "model", "n_pages", "cer_mean", "cer_median"])


# --- samples and splits ----------------------------------------------------------------------------------------


_LETRA = f"""CASE WHEN contains(l, 'encadenada') THEN 'procesal encadenada' WHEN l = 'procesal' OR starts_with(l, 'procesal/') THEN 'procesal'
  WHEN contains(l, 'cortesana') OR contains(l, 'cortesano') THEN 'cortesana/procesal' WHEN contains(l, 'humanística') THEN 'humanística/procesal' ELSE coalesce(l, '') END"""
_CATALOG = f"""firsts AS (SELECT *, {sql.strip("lower(letra)")} AS l FROM document_entry WHERE entry_id IN (SELECT min(entry_id) FROM document_entry WHERE doc_id IS NOT NULL GROUP BY doc_id)),
docs AS (SELECT *, coalesce(siglo, 'unknown') || '_' || {_LETRA} AS stratum FROM firsts),
ranks AS (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM docs),
chosen AS (SELECT stratum, doc_id, rank FROM ranks WHERE rank <= least(1 + n // 6, n))"""
_COUNTED = ", ".join(f"(SELECT count(*) FROM docs p JOIN chosen USING (doc_id) WHERE p.{c} = r.{c}) AS {c}_n" for c in ("provincia", "tipologia", "copista"))
_SCORED_DOCS = f"""{_CATALOG}, rest AS (SELECT r.*, {_COUNTED} FROM docs r WHERE doc_id NOT IN (SELECT doc_id FROM chosen)),
scores AS (SELECT doc_id, facsimile_pages, greatest(0, 3 - provincia_n) + greatest(0, 3 - tipologia_n) + CASE WHEN copista IS NULL OR copista IN ('', '---') THEN 0 ELSE greatest(0, 2 - copista_n) END
  + CASE WHEN len(facsimile_pages) <= 2 THEN 2 WHEN len(facsimile_pages) <= 4 THEN 1 ELSE 0 END AS score FROM rest)"""


def _catalog(spark, d):
    return sampling.first_entries(table(spark, d, "document_entry"))


@query("sample_p1_documents", f"WITH {_CATALOG} SELECT stratum, doc_id, rank FROM chosen")
def stratified_documents(spark, d):
    return sampling.stratified_documents(_catalog(spark, d))


@query("sample_p1_diversity", f"WITH {_SCORED_DOCS} SELECT doc_id, CAST(score AS INT) AS score FROM scores")
def diversity(spark, d):
    entries = _catalog(spark, d)
    return sampling.diversity(entries, sampling.stratified_documents(entries)).select("doc_id", "score")


#: Pages that the samples are to have.
SAMPLE_PAGES, VALID_SAMPLE_PAGES = 400, 50


@query(
    "sample_p1_pages",
    f"""WITH {_SCORED_DOCS}, had AS (SELECT coalesce(sum(least(len(facsimile_pages), 3)), 0) AS had FROM docs JOIN chosen USING (doc_id)),
fill AS (SELECT doc_id FROM (SELECT doc_id, coalesce(sum(least(len(facsimile_pages), 3)) OVER (ORDER BY -score, md5('42-fill|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scores), had WHERE had + before < {SAMPLE_PAGES}),
taken AS (SELECT doc_id, facsimile_pages AS f FROM docs WHERE doc_id IN (SELECT doc_id FROM chosen UNION SELECT doc_id FROM fill)),
pages AS (SELECT doc_id, unnest(CASE WHEN len(f) <= 3 THEN f ELSE list_concat(f[1:1], list_transform(list_sort(list_transform(f[2:], lambda p: [md5('42-page|' || doc_id || '|' || p), p]))[1:2], lambda x: x[2])) END) AS page FROM taken)
SELECT doc_id, page FROM pages ORDER BY md5('42-trim|' || doc_id || '|' || page), doc_id, page LIMIT {SAMPLE_PAGES}""",
)
def sample_pages(spark, d):
    """The limit is the size of the sample."""
    return sampling.sample_pages(_catalog(spark, d), SAMPLE_PAGES)


@query(
    "sample_p2_pages",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM ({FOLIO_PAGES_SQL})),
m AS (SELECT *, i <= 3 OR i > n - 2 AS ends FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ends ORDER BY md5('42-middle|' || doc_id || '|' || page_no)) AS r FROM m),
v AS (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) = 1 AS first FROM c WHERE (n <= 5 OR ends OR r <= 10) AND {_VALID}),
k AS (SELECT *, CASE WHEN v BETWEEN 2 AND 5 THEN 0 WHEN first THEN 1 ELSE 2 END AS rank FROM v),
o AS (SELECT doc_id, page_no, rank, row_number() OVER (ORDER BY rank, md5('42-trim|' || doc_id || '|' || page_no), doc_id, page_no) AS p FROM k WHERE rank > 0)
SELECT doc_id, page_no FROM k WHERE rank = 0 UNION ALL SELECT doc_id, page_no FROM o WHERE p <= {VALID_SAMPLE_PAGES} - (SELECT count(*) FROM k WHERE rank = 0)""",
)
def sample_valid_pages(spark, d):
    """The limit is the size of the sample."""
    return sampling.sample_valid_pages(table(spark, d, "transcripcion"), VALID_SAMPLE_PAGES)


@query(
    "sample_p3_train_split",
    """WITH s AS (SELECT doc_id, count(*) AS pages FROM manifest WHERE doc_id IS NOT NULL GROUP BY doc_id), t AS (SELECT CAST(floor(sum(pages) * 0.2) AS BIGINT) AS target FROM s),
r AS (SELECT doc_id, pages, coalesce(sum(pages) OVER (ORDER BY pages, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY pages, doc_id) AS k FROM s),
o AS (SELECT r.*, before + pages > target + pages // 2 AS over FROM r, t), e AS (SELECT *, bool_or(over) OVER (ORDER BY k) AS ended FROM o)
SELECT doc_id, pages, CASE WHEN NOT ended OR k <= 2 THEN 'train' ELSE 'validation' END AS split FROM e""",
)
def train_split(spark, d):
    return sampling.train_documents(table(spark, d, "manifest"))


# --- layout ----------------------------------------------------------------------------------------------------


def _boxes(spark, d):
    """Boxes made of the numbers of parts: eight to a page of 1600 by 2400."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    x, y = (F.col("p_partkey") * 37) % 1200, (F.col("p_partkey") * 91) % 1900
    return p.select(
        F.concat(F.lit("page_"), F.floor(F.col("p_partkey") / 8).cast("string")).alias("page_id"),
        F.col("p_partkey").alias("box_id"),
        x.cast("int").alias("x1"),
        y.cast("int").alias("y1"),
        (x + 60 + F.col("p_size") * 6).cast("int").alias("x2"),
        (y + 40 + F.col("p_size") * 8).cast("int").alias("y2"),
        F.when(F.col("p_partkey") % 3 == 0, "margin").otherwise("main_text").alias("region_type"),
        ((F.col("p_partkey") % 10 + 1) / 10.0).alias("confidence"),
        F.lit(1600).alias("page_width"),
        F.lit(2400).alias("page_height"),
    )


_BOXES = """boxes AS (SELECT 'page_' || CAST(p_partkey // 8 AS VARCHAR) AS page_id, p_partkey AS box_id, CAST((p_partkey * 37) % 1200 AS INT) AS x1, CAST((p_partkey * 91) % 1900 AS INT) AS y1,
  CAST((p_partkey * 37) % 1200 + 60 + p_size * 6 AS INT) AS x2, CAST((p_partkey * 91) % 1900 + 40 + p_size * 8 AS INT) AS y2, CASE WHEN p_partkey % 3 = 0 THEN 'margin' ELSE 'main_text' END AS region_type FROM part)"""


@query("g3_reading_order", f"WITH {_BOXES} SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ((y1 + y2) // 2) // 48, (x1 + x2) // 2, box_id) AS INT) AS place FROM boxes")
def g3_reading_order(spark, d):
    return layout.reading_order(_boxes(spark, d)).select("page_id", "box_id", "place")


@query(
    "j12_overlaps",
    f"""WITH {_BOXES}, p AS (SELECT a.page_id, a.box_id AS box_a, b.box_id AS box_b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS s FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id)
SELECT page_id, box_a, box_b, i / s AS share FROM p WHERE i / s >= 0.3""",
)
def j12_overlaps(spark, d):
    return layout.overlapping(_boxes(spark, d))


@query("g2_resolved")
def g2_resolved(spark, d):
    return layout.resolve_overlaps(_boxes(spark, d))


def _areas(spark, d):
    """Content areas made of the numbers of orders."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("page_id"), F.lit(100).alias("x1"), F.lit(50).alias("y1"), (F.lit(100) + 300 + F.col("o_custkey") % 5000).cast("int").alias("x2"), (F.lit(50) + 200 + F.col("o_orderkey") % 6000).cast("int").alias("y2"))


_AREAS = "areas AS (SELECT o_orderkey AS page_id, 100 AS x1, 50 AS y1, CAST(400 + o_custkey % 5000 AS INT) AS x2, CAST(250 + o_orderkey % 6000 AS INT) AS y2 FROM orders)"


@query(
    "g5_strips",
    f"""WITH {_AREAS}, s AS (SELECT page_id, y2 AS e, CASE WHEN y2 - y1 <= 1568 THEN [y1] ELSE range(y1, y2, 1368) END AS st FROM areas),
c AS (SELECT page_id, e, st, CASE WHEN len(st) > 1 THEN list_min(list_filter(st, lambda x: least(x + 1568, e) - x < 1568 * 0.2)) END AS f FROM s),
k AS (SELECT page_id, e, f, CASE WHEN f IS NULL THEN st ELSE list_filter(st, lambda x: x < f) END AS st FROM c),
u AS (SELECT page_id, e, f, st, unnest(range(0, len(st))) AS strip FROM k)
SELECT page_id, CAST(strip AS INT) AS strip, CAST(st[strip + 1] AS INT) AS y1, CAST(CASE WHEN f IS NOT NULL AND strip = len(st) - 1 THEN e ELSE least(st[strip + 1] + 1568, e) END AS INT) AS y2 FROM u""",
)
def g5_strips(spark, d):
    return layout.strips(_areas(spark, d), F.lit(1568))


@query(
    "g6_tiles",
    f"""WITH {_AREAS}, g AS (SELECT page_id, x2 AS r, y2 AS b, range(x1, x2, 1368) AS xs, range(y1, y2, 1368) AS ys FROM areas),
c AS (SELECT page_id, r, b, CASE WHEN len(xs) > 1 AND r - xs[-1] < 1568 * 0.2 THEN xs[:-2] ELSE xs END AS xs, CASE WHEN len(ys) > 1 AND b - ys[-1] < 1568 * 0.2 THEN ys[:-2] ELSE ys END AS ys FROM g),
u AS (SELECT *, unnest(range(0, len(ys))) AS row FROM c), v AS (SELECT *, unnest(range(0, len(xs))) AS col FROM u)
SELECT page_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(xs[col + 1] AS INT) AS x1, CAST(ys[row + 1] AS INT) AS y1, CAST(CASE WHEN col = len(xs) - 1 THEN r ELSE least(xs[col + 1] + 1568, r) END AS INT) AS x2,
  CAST(CASE WHEN row = len(ys) - 1 THEN b ELSE least(ys[row + 1] + 1568, b) END AS INT) AS y2 FROM v""",
)
def g6_tiles(spark, d):
    return layout.tiles(_areas(spark, d), F.lit(1568))


@query("g4_scale", f"WITH {_AREAS} SELECT page_id, CASE WHEN greatest(x2, y2) <= 1568 THEN 1.0::DOUBLE ELSE 1568::DOUBLE / greatest(x2, y2) END AS scale, CASE WHEN y2 > 1568 THEN 1568 END AS strip_height FROM areas")
def g4_scale(spark, d):
    most = F.lit(1568)
    return _areas(spark, d).select("page_id", layout.scale(F.col("x2"), F.col("y2"), most).alias("scale"), layout.strip_height(F.col("y2"), most).alias("strip_height"))


@query(
    "g7_content_box",
    f"""WITH {_BOXES}, c AS (SELECT *, (box_id % 10 + 1) / 10 AS confidence FROM boxes), t AS (SELECT page_id, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d, max(confidence) AS s FROM c WHERE region_type = 'main_text' GROUP BY page_id),
j AS (SELECT DISTINCT c.page_id, a, b, t.c, d, coalesce((t.c - a) * (d - b) >= 1600 * 2400 * 0.5 AND s >= 0.6, false) AS ok FROM c LEFT JOIN t USING (page_id))
SELECT page_id, CASE WHEN ok THEN a ELSE 0 END AS x1, CASE WHEN ok THEN b ELSE 0 END AS y1, CASE WHEN ok THEN c ELSE 1600 END AS x2, CASE WHEN ok THEN d ELSE 2400 END AS y2 FROM j""",
)
def g7_content_box(spark, d):
    return layout.content_box(_boxes(spark, d))


@query(
    "g8_blocks",
    f"""WITH {_BOXES}, o AS (SELECT *, (box_id % 10 + 1) / 10 AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY ((y1 + y2) // 2) // 48, (x1 + x2) // 2, box_id) AS place FROM boxes),
c AS (SELECT *, CASE WHEN place > 1 AND lag(region_type) OVER w = region_type AND lag(confidence) OVER w = confidence THEN 0 ELSE 1 END AS begins FROM o WINDOW w AS (PARTITION BY page_id ORDER BY place)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY page_id ORDER BY place) AS run FROM c),
b AS (SELECT page_id, run, any_value(region_type) AS region_type, string_agg('text of ' || box_id, chr(10) ORDER BY place) AS body FROM r GROUP BY page_id, run)
SELECT page_id, string_agg(CASE WHEN region_type = 'margin' THEN '[margen: ' || body || ']' ELSE body END, chr(10) ORDER BY run) AS text FROM b GROUP BY page_id""",
)
def g8_blocks(spark, d):
    ordered = layout.reading_order(_boxes(spark, d))
    return layout.join_blocks(ordered.withColumn("text", F.concat(F.lit("text of "), F.col("box_id").cast("string"))))


@query(
    "g9_region_lines",
    f"""WITH {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ((y1 + y2) // 2) // 48, (x1 + x2) // 2, box_id) AS place FROM boxes)
SELECT page_id, CAST(place AS INT) AS place, printf('Region %d: type=%s, confidence=%d%%, position=(%d,%d)-(%d,%d), size=%dx%d, area=%.1f%%', place - 1, region_type, (box_id % 10 + 1) * 10, x1, y1, x2, y2, x2 - x1, y2 - y1,
  (x2 - x1) * (y2 - y1) / 38400.0::DOUBLE) AS line FROM o""",
)
def g9_region_lines(spark, d):
    return layout.region_lines(layout.reading_order(_boxes(spark, d)))


@query(
    "w5_runs",
    """WITH r AS (SELECT model, hyp_id, page_id, CASE WHEN row_number() OVER w = 1 OR page_id IS DISTINCT FROM lag(page_id) OVER w THEN 1 ELSE 0 END AS c FROM hypothesis WINDOW w AS (PARTITION BY model ORDER BY hyp_id))
SELECT model, hyp_id, CAST(sum(c) OVER (PARTITION BY model ORDER BY hyp_id) AS BIGINT) AS run FROM r""",
)
def w5_runs(spark, d):
    rows = layout.runs(table(spark, d, "hypothesis"), ["model"], "hyp_id", ["page_id"])
    return rows.select("model", "hyp_id", "run")


@query(
    "w1_running_pages",
    """SELECT doc_id, n, CAST(coalesce(sum(n) OVER (ORDER BY n, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
FROM (SELECT doc_id, count(*) AS n FROM manifest WHERE doc_id IS NOT NULL GROUP BY doc_id)""",
)
def w1_running_pages(spark, d):
    sizes = table(spark, d, "manifest").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    return sampling.running_total(sizes, "doc_id", "n").select("doc_id", "n", "before")
