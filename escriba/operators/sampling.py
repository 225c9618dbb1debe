"""Samples and splits of documents that the evaluation uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.functions.editions import folio_pages, is_transcribed
from escriba.functions.text import normalize_letra


def draw(*columns: Column | str, seed: int | str = 42) -> Column:
    """A text that depends on the values and the seed alone and orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def slice_of(drawn: Column | str) -> Column:
    """One of 4096 slices of the order of draws."""
    return F.substring(drawn, 1, 3)


def running_before(rows: DataFrame, slices: list[Column], order: list[Column | str], weight: str, name: str) -> DataFrame:
    """Sum of the weights before each row in an order whose first part, ``slices``, has few values: sums of slices come first, and only
    rows of one slice are ordered in one task."""
    rows = rows.withColumn("_slice", F.struct(*[c.alias(f"s{i}") for i, c in enumerate(slices)]))
    sums = rows.groupBy("_slice").agg(F.sum(weight).alias("_own"))
    base = sums.select("_slice", (F.sum("_own").over(Window.orderBy("_slice")) - F.col("_own")).alias("_base"))  # one row a slice
    inside = Window.partitionBy("_slice").orderBy(*order)
    return rows.join(F.broadcast(base), "_slice").withColumn(name, F.col("_base") + F.sum(weight).over(inside) - F.col(weight)).drop("_slice", "_base")


def split_id(page_id: Column) -> tuple[Column, Column]:
    """Document and page of an identifier, cut at its last underscore."""
    pattern = r"(?s)^(.*)_([^_]*)$"
    return F.regexp_extract(page_id, pattern, 1), F.regexp_extract(page_id, pattern, 2)


def eligible(catalog: DataFrame) -> DataFrame:
    """Entries that were downloaded and have pages."""
    return catalog.where("downloaded").where(F.size("facsimile_pages") > 0)


def strata(catalog: DataFrame) -> DataFrame:
    """Each entry with its stratum: century and script in broad groups."""
    letra = F.coalesce(normalize_letra(F.col("letra")), F.lit(""))
    return catalog.withColumn("stratum", F.concat_ws("_", F.coalesce("siglo", F.lit("unknown")), letra))


def stratified_documents(catalog: DataFrame, seed: int = 42, extra: int = 6) -> DataFrame:
    """From each stratum one document, and one more per ``extra`` of its documents, in the order of a seeded draw.

    Only documents of small draw are ranked: the bound that keeps enough of them comes from counts per stratum and slice
    of the draw, so that a stratum of any size is never sorted whole.
    """
    docs = strata(catalog).groupBy("doc_id").agg(F.min("stratum").alias("stratum"))
    docs = docs.withColumn("d", draw("doc_id", seed=seed)).withColumn("slice", slice_of("d"))
    counts = docs.groupBy("stratum", "slice").agg(F.count("*").alias("c"))
    w = Window.partitionBy("stratum").orderBy("slice")  # 4096 rows at most
    total = F.sum("c").over(Window.partitionBy("stratum"))
    wanted = F.lit(1) + F.floor(total / extra).cast("long")
    bounds = counts.withColumn("before", F.sum("c").over(w) - F.col("c")).withColumn("wanted", F.least(wanted, total)).where("before < wanted")
    near = docs.join(bounds.select("stratum", "slice", "before", "wanted"), ["stratum", "slice"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "slice").orderBy("d", "doc_id"))
    return near.withColumn("rank", rank).where("rank <= wanted").select("stratum", "doc_id", "rank")


def diversity(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """Score of each document that is not chosen: rare provinces, types and scribes among the chosen, and few pages, count for it."""
    picked = catalog.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = catalog.join(chosen.select("doc_id").distinct(), "doc_id", "left_anti")
    for column, most in (("provincia", 3), ("tipologia", 3), ("copista", 2)):
        counts = picked.groupBy(column).agg(F.count("*").alias(f"{column}_n"))
        rest = rest.join(counts, column, "left").withColumn(f"{column}_score", F.greatest(F.lit(0), F.lit(most) - F.coalesce(f"{column}_n", F.lit(0))))
    scribe = F.when(F.col("copista").isNull() | F.col("copista").isin("", "---"), 0).otherwise(F.col("copista_score"))
    pages = F.size("facsimile_pages")
    short = F.when(pages <= 2, 2).when(pages <= 4, 1).otherwise(0)
    return rest.select("doc_id", "facsimile_pages", (F.col("provincia_score") + F.col("tipologia_score") + scribe + short).alias("score"))


def first_entries(catalog: DataFrame, key: str = "entry_id") -> DataFrame:
    """One row per document, the first that was entered."""
    names = [c for c in catalog.columns if c != "doc_id"]
    first = catalog.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*names), key).alias("e"))
    return first.select("doc_id", *[F.col(f"e.{n}").alias(n) for n in names])


def sample_pages(catalog: DataFrame, target: int, most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, page) of a sample of about ``target`` pages, never more.

    Documents of all strata first, then those of highest diversity score, ties by draw, until the pages to be had reach the target; of each the first
    page and others by draw; pages beyond the target go by draw. ``catalog`` has one row per document; those without pages count for nothing.
    """
    chosen = stratified_documents(catalog, seed).select("doc_id")
    pages = F.least(F.size("facsimile_pages"), F.lit(most)).cast("long")
    had = catalog.join(chosen, "doc_id", "left_semi").agg(F.coalesce(F.sum(pages), F.lit(0)).alias("had"))
    rest = diversity(catalog, chosen).withColumn("pages", pages).withColumn("d", draw("doc_id", seed=f"{seed}-fill"))
    ordered = running_before(rest, [-F.col("score"), slice_of("d")], ["d", "doc_id"], "pages", "before")
    fill = ordered.crossJoin(F.broadcast(had)).where(F.col("had") + F.col("before") < target).select("doc_id")  # one row
    found = pages_of(catalog.join(chosen.unionByName(fill), "doc_id", "left_semi"), most, seed)
    return found.withColumn("d", draw("doc_id", "page", seed=f"{seed}-trim")).orderBy("d", "doc_id", "page").limit(target).drop("d")


def pages_of(catalog: DataFrame, most: int = 3, seed: int = 42) -> DataFrame:
    """Pages of each document: all if they are few, else the first and others by a seeded draw."""
    rest = F.slice("facsimile_pages", 2, F.greatest(F.size("facsimile_pages"), F.lit(1)))
    shuffled = F.array_sort(F.transform(rest, lambda p: F.struct(draw("doc_id", p, seed=f"{seed}-page").alias("d"), p.alias("p"))))
    drawn = F.concat(F.slice("facsimile_pages", 1, 1), F.transform(F.slice(shuffled, 1, most - 1), lambda x: x["p"]))
    return catalog.select("doc_id", F.explode(F.when(F.size("facsimile_pages") <= most, F.col("facsimile_pages")).otherwise(drawn)).alias("page"))


def valid_pages(documents: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """Pages of transcriptions that hold text enough."""
    return folio_pages(documents, key, text).where(is_transcribed(F.col("page_text"))).select(key, "page_no")


def sample_valid_pages(documents: DataFrame, target: int, key: str = "doc_id", text: str = "md", seed: int = 42, short: int = 5, many: int = 15) -> DataFrame:
    """(key, page_no) of up to ``target`` pages that hold text enough.

    Of documents with up to ``short`` pages all are looked at, of longer ones the first three, the last two and others by draw, ``many`` in all. If too many
    are valid, documents with 2 to ``short`` valid ones keep all of them; the others give their first pages, by draw if too many, then further ones by draw.
    """
    every = folio_pages(documents, key, text)
    place, count = Window.partitionBy(key).orderBy("page_no"), Window.partitionBy(key)  # the pages of one document
    every = every.withColumn("i", F.row_number().over(place)).withColumn("n", F.count("*").over(count))
    ends = (F.col("i") <= 3) | (F.col("i") > F.col("n") - 2)
    by_draw = Window.partitionBy(key, ends).orderBy(draw(key, F.col("page_no").cast("string"), seed=f"{seed}-middle"))
    candidate = (F.col("n") <= short) | ends | (F.row_number().over(by_draw) <= many - 5)
    valid = every.withColumn("candidate", candidate).where("candidate").where(is_transcribed(F.col("page_text"))).select(key, "page_no")
    valid = valid.withColumn("v", F.count("*").over(count)).withColumn("first", F.row_number().over(place) == 1)
    kept = F.col("v").between(2, short)
    valid = valid.withColumn("rank", F.when(kept, 0).when(F.col("first"), 1).otherwise(2)).withColumn("d", draw(key, F.col("page_no").cast("string"), seed=f"{seed}-trim"))
    sure = valid.where("rank = 0").select(key, "page_no")
    ordered = running_before(valid.where("rank > 0").withColumn("one", F.lit(1).cast("long")), [F.col("rank"), slice_of("d")], ["d", key, "page_no"], "one", "before")
    quota = sure.agg((F.lit(target) - F.count("*")).alias("quota"))
    return sure.unionByName(ordered.crossJoin(F.broadcast(quota)).where("before < quota").select(key, "page_no"))  # one row


def running_total(rows: DataFrame, group: str, weight: str, total: str = "before", slices: int = 1024) -> DataFrame:
    """Sum of the weights of all rows before each one, ordered by (weight, group), without one task for all.

    Weights are whole numbers; sums per weight come first, weights above ``slices`` share one slice that is ordered within.
    """
    rows = rows.withColumn("_slice", F.least(F.col(weight), F.lit(slices)).cast("long"))
    sums = rows.groupBy("_slice").agg(F.sum(weight).alias("_own"))
    base = sums.withColumn("_base", F.sum("_own").over(Window.orderBy("_slice")) - F.col("_own")).drop("_own")  # `slices` rows at most
    inside = Window.partitionBy("_slice").orderBy(weight, group)
    before = F.col("_base") + F.sum(weight).over(inside) - F.col(weight)
    return rows.join(F.broadcast(base), "_slice").withColumn(total, before).drop("_slice", "_base")  # `slices` rows at most


def train_documents(rows: DataFrame, ratio: float = 0.2, least: int = 2) -> DataFrame:
    """(doc_id, pages, split): smallest documents to train until the next would overshoot by more than half of itself.

    The first that would overshoot ends the taking; at least two documents are taken. Ties by identifier.
    """
    sizes = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("pages"))
    total = sizes.agg(F.floor(F.sum("pages") * ratio).alias("target"))
    ranked = running_total(sizes, "doc_id", "pages").crossJoin(F.broadcast(total))  # one row
    over = ranked.where(F.col("before") + F.col("pages") > F.col("target") + F.floor(F.col("pages") / 2))
    stop = over.agg(F.min(F.struct("pages", "doc_id")).alias("stop"))
    first = ranked.orderBy("pages", "doc_id").limit(least).select("doc_id", F.lit(True).alias("kept"))
    joined = ranked.crossJoin(F.broadcast(stop)).join(F.broadcast(first), "doc_id", "left")  # one row; `least` rows
    train = F.col("stop").isNull() | (F.struct("pages", "doc_id") < F.col("stop")) | F.coalesce("kept", F.lit(False))
    return joined.select("doc_id", "pages", F.when(train, "train").otherwise("validation").alias("split"))
