"""Dictionary lookup: unknown words, close vocabulary words, compounds, abbreviations, and applying corrections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.functions.text import strip

# Letters of a word, and the alphabet of the prefixes that are tried.
WORD = "[a-záéíóúñçüA-ZÁÉÍÓÚÑÇÜ]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzáéíóúñçü"


def vocabulary(*forms: DataFrame) -> DataFrame:
    """Lower-case forms of all sources, each once; a source has one column of strings or of arrays of strings."""
    out = None
    for rows in forms:
        name, kind = rows.dtypes[0]
        value = F.explode(name) if kind.startswith("array") else F.explode(F.map_keys(name)) if kind.startswith("map") else F.col(name)
        part = rows.select(value.alias("form")).select(F.lower("form").alias("form"))
        out = part if out is None else out.unionByName(part)
    return out.where("form IS NOT NULL AND form <> ''").distinct()


def abbreviations(rows: DataFrame, order: str = "id") -> DataFrame:
    """(abbreviated, expanded), lower case, of alternatives the first; of rows for one abbreviation the last."""
    plain = rows.select(F.lower("abbreviated").alias("abbreviated"), F.lower(strip(F.element_at(F.split("expanded", "/"), 1))).alias("expanded"), F.col(order).alias("o"))
    return plain.groupBy("abbreviated").agg(F.max_by("expanded", "o").alias("expanded"))


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """V1: every word of a text in lower case, without its place."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), 1)
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("original")).withColumn("word", F.lower("original"))


def tokens_with_places(texts: DataFrame, key: str, text: str) -> DataFrame:
    """V1 with the places of each word in its text. Places come from the lengths of what stands between the words."""
    rows = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"))
    rows = rows.select(key, F.regexp_extract_all("t", F.lit(f"({WORD})"), 1).alias("words"), F.transform(F.split("t", WORD), F.length).alias("gaps"))
    rows = rows.withColumn("sizes", F.transform("words", F.length))
    # the words' starts: all gaps up to and with the one before, and all words before
    numbered = F.transform(
        "words",
        lambda w, i: F.struct(
            w.alias("original"),
            (F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, g: a + g) + F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, g: a + g)).alias("start"),
        ),
    )
    out = rows.select(key, F.posexplode(numbered).alias("place", "w")).select(key, "place", "w.original", "w.start")
    return out.withColumn("end", F.col("start") + F.length("original")).withColumn("word", F.lower("original"))


def unknown_words(found: DataFrame, vocab: DataFrame, least: int = 3) -> DataFrame:
    """Words of some length that the vocabulary lacks."""
    return found.where(F.length("word") >= least).join(vocab, found.word == vocab.form, "left_anti")


def block_key(word: Column) -> Column:
    """V2: the first two letters; shorter words are their own."""
    return F.substring(word, 1, 2)


def block_keys(word: Column) -> Column:
    """The blocks to look in: the word's own, its letters swapped, and either letter replaced."""
    key = block_key(word)
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    first, second = F.substring(key, 1, 1), F.substring(key, 2, 1)
    swapped = F.when(F.length(key) == 2, F.concat(second, first)).otherwise(key)
    varied_first = F.transform(letters, lambda c: F.concat(c, second))
    varied_second = F.when(F.length(key) == 2, F.transform(letters, lambda c: F.concat(first, c))).otherwise(F.array(key))
    return F.array_distinct(F.concat(F.array(key, swapped), varied_first, varied_second))


def candidates(words: DataFrame, vocab: DataFrame, distance: int = 3, top: int = 3) -> DataFrame:
    """Per different word the closest vocabulary words: (word, candidate, distance, rank).

    Joined by block, filtered by length, then by distance with a cut-off. Repeated words are looked up once.
    """
    asked = words.select("word").distinct().withColumn("block", F.explode(block_keys(F.col("word"))))
    known = vocab.select(F.col("form").alias("candidate"), block_key(F.col("form")).alias("block"))
    near = asked.join(known, "block").where(F.abs(F.length("word") - F.length("candidate")) <= distance)
    near = near.withColumn("distance", F.levenshtein("word", "candidate", distance)).where("distance >= 0")
    best = Window.partitionBy("word").orderBy("distance", "candidate")
    return near.select("word", "candidate", "distance").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def compounds(words: DataFrame, vocab: DataFrame, least: int = 2, parts: int = 3) -> DataFrame:
    """V4: (word, parts) of words that fall into two vocabulary words, else three; of several ways the first."""
    asked = words.select("word").distinct().withColumn("n", F.length("word"))
    cuts = asked.where(F.col("n") >= 2 * least).select("word", "n", F.explode(F.sequence(F.lit(least), F.col("n") - least)).alias("i"))
    form = vocab.select("form")
    left = cuts.withColumn("left", F.substring(F.col("word"), F.lit(1), F.col("i"))).join(form, F.col("left") == F.col("form"), "left_semi")
    two = left.withColumn("right", F.substring(F.col("word"), F.col("i") + 1, F.col("n"))).join(form, F.col("right") == F.col("form"), "left_semi")
    found = two.groupBy("word").agg(F.min_by(F.array("left", "right"), "i").alias("parts"))
    if parts < 3:
        return found
    more = left.join(found, "word", "left_anti").where(F.col("n") - F.col("i") >= 2 * least)
    more = more.select("word", "n", "i", "left", F.explode(F.sequence(F.col("i") + least, F.col("n") - least)).alias("j"))
    more = more.withColumn("mid", F.substring(F.col("word"), F.col("i") + 1, F.col("j") - F.col("i"))).join(form, F.col("mid") == F.col("form"), "left_semi")
    more = more.withColumn("right", F.substring(F.col("word"), F.col("j") + 1, F.col("n"))).join(form, F.col("right") == F.col("form"), "left_semi")
    three = more.groupBy("word").agg(F.min_by(F.array("left", "mid", "right"), F.struct("i", "j")).alias("parts"))
    return found.unionByName(three)


def expansions(words: DataFrame, vocab: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """(word, expansions): the word's own expansion, then those of abbreviations inside it, if the vocabulary has them.

    Inner abbreviations are found by joining on every part of the word, so that nothing is compared with everything.
    """
    asked = words.select("word").distinct()
    n = F.length("word")
    pieces = asked.select("word", F.explode(F.sequence(F.lit(1), n)).alias("i")).select("word", "i", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("i") + 1)).alias("size"))
    pieces = pieces.withColumn("abbreviated", F.substring(F.col("word"), F.col("i"), F.col("size")))
    hits = pieces.join(abbrevs, "abbreviated").groupBy("word", "abbreviated", "expanded").agg(F.min("i").alias("i"))
    whole = F.col("abbreviated") == F.col("word")
    rest = F.substring(F.col("word"), F.col("i") + F.length("abbreviated"), F.length("word"))
    built = F.concat(F.substring(F.col("word"), F.lit(1), F.col("i") - 1), F.col("expanded"), rest)
    hits = hits.withColumn("candidate", F.when(whole, F.col("expanded")).otherwise(built)).withColumn("order", F.when(whole, 0).otherwise(1))
    kept = hits.join(vocab.select(F.col("form").alias("candidate")), "candidate", "left_semi")
    once = kept.groupBy("word", "candidate").agg(F.min(F.struct("order", "abbreviated")).alias("first"))
    return once.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("first", "candidate"))).alias("l")).select("word", F.transform("l", lambda x: x["candidate"]).alias("expansions"))


def candidates_table(found: DataFrame, vocab: DataFrame, abbrevs: DataFrame, distance: int = 3, top: int = 3) -> DataFrame:
    """V6: unknown words with their candidates, compounds and expansions; null where there are none."""
    unknown = unknown_words(found, vocab)
    near = candidates(unknown, vocab, distance, top).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("distance", "candidate"))).alias("edit_candidates"))
    return (
        unknown.join(near, "word", "left")
        .join(compounds(unknown, vocab).withColumnRenamed("parts", "compound"), "word", "left")
        .join(expansions(unknown, vocab, abbrevs), "word", "left")
    )


def correction_prompt(table: DataFrame, key: str) -> DataFrame:
    """V7: per text one line per unknown word in the order of places: its number, itself, what it could be."""
    near = F.transform(F.coalesce("edit_candidates", F.array().cast("array<struct<distance:int,candidate:string>>")), lambda c: F.format_string("%s (d=%d)", c["candidate"], c["distance"]))
    split = F.when(F.col("compound").isNotNull(), F.array(F.concat(F.lit("split: "), F.array_join("compound", " + ")))).otherwise(F.array().cast("array<string>"))
    abbr = F.when(F.col("expansions").isNotNull(), F.array(F.concat(F.lit("abbrev: "), F.array_join("expansions", ", ")))).otherwise(F.array().cast("array<string>"))
    said = F.array_join(F.concat(near, split, abbr), ", ")
    rows = table.select(key, F.struct(F.col("start"), F.concat(F.lit("'"), "word", F.lit("' ["), said, F.lit("]")).alias("line")).alias("l"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n").alias("prompt"))


def parse_corrections(response: Column) -> Column:
    """lines "number: word" of an answer as an array of (number, word)."""
    pattern = r"^\s*(\d+)\s*:\s*(.+?)\s*$"
    lines = F.filter(F.split(response, r"\r?\n"), lambda line: line.rlike(pattern))
    return F.transform(lines, lambda line: F.struct(F.regexp_extract(line, pattern, 1).cast("int").alias("number"), F.regexp_extract(line, pattern, 2).alias("word")))


def default_choice(table: DataFrame) -> DataFrame:
    """What is chosen where no one chooses: the closest candidate, or the word as it is."""
    first = F.try_element_at("edit_candidates", F.lit(1))["candidate"]
    return table.withColumn("replacement", F.coalesce(first, F.col("original")))


def apply_corrections(text: Column, replacements: Column) -> Column:
    """an array of (start, end, replacement) put into a text from its end to its start, so that places stay right."""
    ordered = F.reverse(F.array_sort(replacements))
    return F.aggregate(
        ordered,
        text,
        lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"]), r["replacement"], F.substring(t, r["end"] + 1, F.length(t))),
    )


def corrected_texts(texts: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """Every text with the chosen replacements in it."""
    per_text = chosen.groupBy(key).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("r"))
    joined = texts.join(per_text, key, "left")
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    return joined.select(key, apply_corrections(F.col(text), F.coalesce("r", none)).alias("text"))


# Function words that run into the word after them, in the order in which they are tried.
RUN_IN_PREFIXES = (
    "porquelos porquelas porquela porqueel conlasdichas conlosdichos conladicha coneldicho delasdichas delosdichos deladicha deldicho "
    "alasdichas alosdichos aladicha aldicho enlosdichos enlasdichas enladicha eneldicho porlas porlos porla porel conlas conlos conla conel consu "
    "delas delos dela delo del alas alos ala alo al enlas enlos enla enel en las los la lo el su sus"
).split()


def base_word(word: Column) -> Column:
    """V9: a word without the first of the run-in prefixes that leaves two letters or more."""
    low = F.lower(word)
    out = None
    for prefix in RUN_IN_PREFIXES:
        fits = low.startswith(prefix) & (F.length(low) >= len(prefix) + 2)
        out = F.when(fits, F.substring(low, len(prefix) + 1, 1_000_000)) if out is None else out.when(fits, F.substring(low, len(prefix) + 1, 1_000_000))
    return out.otherwise(low)


def abbreviation_instances(texts: DataFrame, key: str, text: str) -> DataFrame:
    """V8: abbreviations of line-split ground truth: (key, line_no, prefix, expansion, suffix, word).

    A line that ends in letters, followed by one or more short lines of lower-case letters alone, which are the letters left out, and
    the start of the next line if no blank comes first. Lines that were taken as expansions start no abbreviation.
    """
    import re

    letters, low = "a-záéíóúçñA-ZÁÉÍÓÚÇÑ", re.compile(r"[a-záéíóúçñ]{1,10}")
    ending, starting = re.compile(rf"([{letters}]+)\s*$"), re.compile(rf"[{letters}]+")

    def scan(lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
        i = 0
        while i < len(lines) - 1:
            end = ending.search(lines[i])
            j = i + 1
            while end and j < len(lines) and low.fullmatch(lines[j].strip()):
                j += 1
            if not end or j == i + 1:
                i += 1
                continue
            after = starting.match(lines[j]) if j < len(lines) else None
            suffix = after.group() if after else ""
            if len(suffix) > 20:
                upper = next((k for k in range(1, len(suffix)) if suffix[k].isupper()), len(suffix))
                suffix = suffix[:upper]
            expansion = "".join(x.strip() for x in lines[i + 1 : j])
            if len(end.group(1) + expansion + suffix) >= 2:
                yield i + 1, end.group(1).lower(), expansion, suffix.lower()
            i = j

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *found, "".join(found[1:])) for k, t in zip(batch[key], batch[text], strict=True) for found in scan(t.split("\n"))]
            yield pd.DataFrame(out, columns=[key, "line_no", "prefix", "expansion", "suffix", "word"])

    rows = texts.where(F.col(text).isNotNull()).select(key, text)
    return rows.mapInPandas(work, f"{key} {dict(rows.dtypes)[key]}, line_no int, prefix string, expansion string, suffix string, word string")


def abbreviation_groups(instances: DataFrame, key: str, examples: int = 15, patterns: int = 10) -> DataFrame:
    """Per expansion its count, different base words, patterns in order of occurrence, and texts it is found in."""
    rows = instances.withColumn("base", base_word(F.col("word"))).withColumn("pattern", F.concat("prefix", F.lit("["), "expansion", F.lit("]"), "suffix"))
    per_pattern = rows.groupBy("expansion", "pattern").agg(F.min(F.struct(F.col(key), F.col("line_no"))).alias("first"))
    ranked = per_pattern.withColumn("r", F.row_number().over(Window.partitionBy("expansion").orderBy("first", "pattern"))).where(F.col("r") <= patterns)
    shown = ranked.groupBy("expansion").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "pattern"))), lambda x: x["pattern"]).alias("patterns"))
    bases = rows.select("expansion", "base").distinct()
    ordered = bases.withColumn("r", F.row_number().over(Window.partitionBy("expansion").orderBy("base"))).where(F.col("r") <= examples)
    words = ordered.groupBy("expansion").agg(F.array_sort(F.collect_list("base")).alias("examples"))
    counts = rows.groupBy("expansion").agg(F.count("*").alias("n"), F.countDistinct(key).alias("texts"))
    return counts.join(words, "expansion").join(shown, "expansion")
