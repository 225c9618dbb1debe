"""Corpus analytics: markers, orthography, counts by dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.functions.text import collapse_whitespace, strip

# Annotation markers and how they are written.
MARKER_PATTERNS = {
    "[margen:]": r"\[\s*margen[^:\]]*:",
    "[firma:]": r"\[\s*firma[^:\]]*:",
    "[tachado:]": r"\[\s*tachado[^:\]]*:",
    "[interlineado:]": r"\[\s*interlineado[^:\]]*:",
    "[sobrescrito:]": r"\[\s*sobrescrito[^:\]]*:",
    "[ilegible]": r"\[\s*ilegible\s*\]",
    "[signo]": r"\[\s*signo\s*\]",
    "[rúbrica]": r"\[\s*r[uú]brica\s*\]",
    "[cruz]": r"\[\s*cruz\s*\]",
    "[blanco]": r"\[\s*blanco\s*\]",
    "[roto]": r"\[\s*roto[^\]]*\]",
    "[mano N:]": r"\[\s*mano\s*\d+[^:\]]*:",
    "[lat.:]": r"\[\s*lat\s*\.\s*[^:\]]*:",
    "[* * *]": r"\[\s*\*\s*\*\s*\*\s*\]",
}

# Spellings of the period, as patterns of lower-case words.
ORTHOGRAPHY = {
    "c_cedilla": "ç",
    "x_for_j": "dixo|dixe|dixier|dixeron|dixese|dexar|dexo|dexa|dexan|dexando|baxo|baxa|abaxo|abax|traxo|traxe|traxer|mexor|exemplo|exerc|examin|fixo|lexo|relox|cax[ao]|quex|consex|cruxifix|exebçion|execuçion|exerç|taxo|pux|aparex|[aeiouáéíóú]x[aeiouáéíóú]",
    "y_for_i": "^y(?:gl|nq|mp|nf|nv|nst|gn|nt[ie]|ns[ti]|ndi|tem|npo|nbi|nven|nfor|magi)",
    "v_for_u": "^v(?:n$|na$|no$|nos$|nas$|nj|uestr|eçin|eziñ|ecin|ezin)",
    "j_for_i": "mj[ln]|quj[nt]|escriu|jnqu|jnfor|ljçen|benefjç|domjnj|preuil|serujç|jçi[oa]|jçe|jsto|jble|çibj|djfinj|finyquj|syguj|bachjll|alquj|jnst|djçi|oblj|escrjp|escjr|rrecjb|jdad$|vjll[ae]|njngu",
    "u_for_b": "escriu|reci[uv]|triu|deui|deue|viui|biui|viu[ie]|aviu",
    "h_missing": "^(?:aver|aze|azer|azj|izo|ombre|onrr)",
    "h_added": "^(?:hebr|hedad|hera$|horden)",
}
DOUBLE_LETTERS = "nn ss ff ll rr pp tt cc mm bb dd gg".split()
WORD = "[a-záéíóúçñA-ZÁÉÍÓÚÇÑ]+"


def marker_counts(texts: DataFrame, text: str) -> DataFrame:
    """How often each marker occurs in all texts; line ends are no part of a marker. Markers that do not occur are left out."""
    flat = F.regexp_replace(F.col(text), "\n", "")
    counts = [F.sum(F.regexp_count(flat, F.lit(f"(?iu){p}"))).alias(str(i)) for i, p in enumerate(MARKER_PATTERNS.values())]
    row = texts.agg(*counts)
    names = F.array(*[F.struct(F.lit(n).alias("marker"), F.col(str(i)).alias("n")) for i, n in enumerate(MARKER_PATTERNS)])
    return row.select(F.explode(names).alias("m")).select("m.*").where("n > 0")


def reconstructed(text: Column) -> Column:
    """Running text of line-split ground truth: headers, line numbers and expansion lines gone, lines joined, bracketed marks out."""
    lines = F.filter(
        F.split(text, "\n", -1),
        lambda x: ~strip(x).rlike(r"^\{h\.\s+\d+[rv]\}$") & ~strip(x).rlike(r"^\d+$") & ~strip(x).rlike("^[a-záéíóúçñ]{1,10}$"),
    )
    return collapse_whitespace(F.regexp_replace(F.array_join(lines, " "), r"\[[^\]]*\]", " "))


#: Examples that are listed of a spelling, of a doubled letter, and of an h missing or added.
EXAMPLES, FEWER_EXAMPLES = 25, 15


def orthography(texts: DataFrame, text: str) -> DataFrame:
    """Per spelling of the period, how many words of the reconstructed text show it, how many different ones, and the first of them by the alphabet.

    Of the c with cedilla its characters are counted, not its words. Words are counted before their spelling is looked at, so each different word is tested once.
    """
    running = texts.where(F.col(text).isNotNull()).select(reconstructed(F.col(text)).alias("t"))
    found = F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1))
    words = running.select(F.explode(found).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    tests = {**ORTHOGRAPHY, **{f"double_{d}": d for d in DOUBLE_LETTERS}}
    shown = F.filter(F.array(*[F.when(F.col("word").rlike(p), F.lit(name)) for name, p in tests.items()]), lambda x: x.isNotNull())
    rows = words.select("word", "n", F.explode(shown).alias("feature"))
    fewer = F.col("feature").startswith("double_") | F.col("feature").startswith("h_")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy("word"))).where(F.col("r") <= F.when(fewer, FEWER_EXAMPLES).otherwise(EXAMPLES))
    listed = first.groupBy("feature").agg(F.array_sort(F.collect_list("word")).alias("examples"))
    times = F.when(F.col("feature") == "c_cedilla", F.col("n") * F.regexp_count("word", F.lit("ç"))).otherwise(F.col("n"))
    return rows.groupBy("feature").agg(F.sum(times).alias("n"), F.count("*").alias("unique_words")).join(listed, "feature")


def counts_by_dimension(rows: DataFrame, dimensions: list[str], top: int = 10) -> DataFrame:
    """The most frequent values of each dimension, in one pass over the rows; ties by value."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])).alias("d")).select("d.*")
    counts = long.where("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def union_of(*layers: DataFrame) -> DataFrame:
    """All rows of tables of one schema."""
    return reduce(DataFrame.unionByName, layers)


#: Rows that a report lists of spellings' words and of abbreviations.
REPORT_ABBREVIATIONS = 50


def corpus_report(texts: DataFrame, key: str, text: str, top: int = REPORT_ABBREVIATIONS) -> DataFrame:
    """K4: (section, place, item, n, detail): totals, markers, spellings of the period, and the most frequent expansions."""
    from escriba.operators.vocabulary import abbreviation_groups, abbreviation_instances

    present = texts.where(F.col(text).isNotNull())
    totals = texts.agg(F.count(text).alias("pages"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("characters"), F.count(F.when(F.col(text).isNull(), 1)).alias("missing"))
    named = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("item"), F.col(n).cast("long").alias("n")) for i, n in enumerate(("pages", "characters", "missing"))])
    nothing = F.lit(None).cast("string")
    parts = [totals.select(F.explode(named).alias("x")).select(F.lit("totals").alias("section"), "x.*", nothing.alias("detail"))]
    order = lambda by: F.row_number().over(Window.orderBy(*by)) - 1  # noqa: E731  (some twenty rows each)
    parts.append(marker_counts(present, text).select(F.lit("markers").alias("section"), order([F.desc("n"), "marker"]).alias("place"), F.col("marker").alias("item"), F.col("n").cast("long").alias("n"), nothing.alias("detail")))
    parts.append(orthography(present, text).select(F.lit("spellings").alias("section"), order(["feature"]).alias("place"), F.col("feature").alias("item"), F.col("n").cast("long").alias("n"), F.array_join("examples", ", ").alias("detail")))
    groups = abbreviation_groups(abbreviation_instances(present, key, text), key).orderBy(F.desc("n"), "expansion").limit(top)
    parts.append(groups.select(F.lit("abbreviations").alias("section"), order([F.desc("n"), "expansion"]).alias("place"), F.col("expansion").alias("item"), F.col("n").cast("long").alias("n"), F.array_join("patterns", ", ").alias("detail")))
    return union_of(*parts)
