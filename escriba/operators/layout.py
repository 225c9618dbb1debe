"""Page geometry: overlap of boxes, reading order, strips and tiles, margins, joining of blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
#: Pixels that neighbouring strips share, and the share of a strip below which the last is taken into the one before.
OVERLAP, TAIL = 200, 0.2


def area(box: Column) -> Column:
    """Area of a struct x1, y1, x2, y2."""
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def overlap_fraction(a: Column, b: Column) -> Column:
    """G1: share of box a that lies in box b."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0) & (area(a) > 0), w * h / area(a)).otherwise(0.0)


def union_box(a: Column, b: Column) -> Column:
    """G1: the smallest box around two."""
    low, high = F.least, F.greatest
    return F.struct(low(a["x1"], b["x1"]).alias("x1"), low(a["y1"], b["y1"]).alias("y1"), high(a["x2"], b["x2"]).alias("x2"), high(a["y2"], b["y2"]).alias("y2"))


def overlapping(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of boxes of a page of which one lies in the other by some share: (page_id, box_a, box_b, share)."""
    box = F.struct(*BOX)
    a = boxes.select("page_id", F.col("box_id").alias("box_a"), box.alias("a"))
    b = boxes.select("page_id", F.col("box_id").alias("box_b"), box.alias("b"))
    share = F.greatest(overlap_fraction(F.col("a"), F.col("b")), overlap_fraction(F.col("b"), F.col("a")))
    return a.join(b, "page_id").where("box_a < box_b").select("page_id", "box_a", "box_b", share.alias("share")).where(F.col("share") >= least)


def large_enough(boxes: DataFrame, classes: DataFrame, least: float = 0.01) -> DataFrame:
    """boxes of known classes, under the class they are mapped to, that fill some share of the page."""
    mapped = boxes.join(classes.dropDuplicates(["class_name"]), "class_name")
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return mapped.where(size >= F.col("page_width") * F.col("page_height") * F.lit(least))


def _inside(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = (a[2] - a[0]) * (a[3] - a[1])
    return w * h / size if w > 0 and h > 0 and size > 0 else 0.0


def settle(boxes: list[tuple[tuple, str, float]]) -> list[tuple[tuple, str, float]]:
    """Boxes (box, type, confidence) of a page until no two clash.

    Taken by confidence. Of one type and 30 % shared: joined. Of two types: the one that lies in the other by more than 70 % (50 %
    where one is much less sure) goes, but text stays before anything else. Last, unsure boxes that are covered go.
    """
    kept = sorted(boxes, key=lambda b: -b[2])

    def clash(first: tuple, second: tuple) -> str | None:
        (a, kind_a, sure_a), (b, kind_b, sure_b) = first, second
        a_in, b_in = _inside(a, b), _inside(b, a)
        if max(a_in, b_in) < 0.3:
            return None
        if kind_a == kind_b:
            return "join"
        bar = 0.5 if min(sure_a, sure_b) / max(sure_a, sure_b) < 0.3 else 0.7
        text_a, text_b = kind_a == "main_text", kind_b == "main_text"
        if b_in > bar and not text_b:
            return "second"
        if a_in > bar and not text_a:
            return "first"
        if max(a_in, b_in) > bar and text_a != text_b:
            return "first" if text_b else "second"
        return None

    again = True
    while again:
        again = False
        i = 0
        while i < len(kept):
            j = i + 1
            gone = False
            while j < len(kept):
                verdict = clash(kept[i], kept[j])
                if verdict == "join":
                    (a, kind, sure), (b, _, other) = kept[i], kept[j]
                    kept[i] = ((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), kind, max(sure, other))
                    del kept[j]
                    again = True
                elif verdict == "second":
                    del kept[j]
                    again = True
                elif verdict == "first":
                    del kept[i]
                    again = gone = True
                    break
                else:
                    j += 1
            i += not gone
    return [b for k, b in enumerate(kept) if b[2] >= 0.15 or max((_inside(b[0], o[0]) for m, o in enumerate(kept) if m != k), default=0) <= 0.8]


def resolve_overlaps(boxes: DataFrame) -> DataFrame:
    """G2 for every page: (page_id, place, x1, y1, x2, y2, region_type, confidence). A page's boxes, some ten, go to one task."""

    def work(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["confidence", "box_id"], ascending=[False, True], kind="stable")
        found = settle([((r.x1, r.y1, r.x2, r.y2), r.region_type, r.confidence) for r in page.itertuples()])
        rows = [(page["page_id"].iloc[0], i, *b, kind, sure) for i, (b, kind, sure) in enumerate(found)]
        return pd.DataFrame(rows, columns=["page_id", "place", *BOX, "region_type", "confidence"])

    schema = "page_id string, place int, x1 int, y1 int, x2 int, y2 int, region_type string, confidence double"
    return boxes.select("page_id", "box_id", *BOX, "region_type", "confidence").groupBy("page_id").applyInPandas(work, schema)


def reading_order(boxes: DataFrame, height: str = "page_height") -> DataFrame:
    """Place of each box of its page: by bands of 2 % of the height, then from left to right; ties by box."""
    tolerance = F.floor(F.col(height) * 0.02)
    cy = F.floor((F.col("y1") + F.col("y2")) / 2)
    cx = F.floor((F.col("x1") + F.col("x2")) / 2)
    band = F.when(tolerance > 0, F.floor(cy / tolerance)).otherwise(cy)
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(band, cx, "box_id")))


def scale(width: Column, height: Column, most: Column) -> Column:
    """By how much a picture is made smaller so that its longer side fits."""
    longest = F.greatest(width, height)
    return F.when(longest <= most, 1.0).otherwise(most / longest)


def strip_height(height: Column, most: Column) -> Column:
    """Height of strips, or null where one does without."""
    return F.when(height > most, most)


def _starts(low: Column, high: Column, most: Column, overlap: int) -> Column:
    step = F.when(most > overlap, most - overlap).otherwise(most)
    return F.sequence(low.cast("int"), F.greatest(low, high - 1).cast("int"), step.cast("int"))


def strips(pages: DataFrame, most: Column, overlap: int = OVERLAP, tail: float = TAIL) -> DataFrame:
    """Horizontal strips of each page's content: (page_id, strip, y1, y2). A last strip that is too low is taken into the one before."""
    y1, y2 = F.col("y1"), F.col("y2")
    starts = F.when(y2 - y1 <= most, F.array(y1.cast("int"))).otherwise(_starts(y1, y2, most, overlap))
    rows = pages.where(y2 > y1).select("page_id", y2.alias("end"), most.alias("most"), starts.alias("starts"))
    # the first strip that is too low ends the page, and the one before it reaches to the end
    low = F.filter("starts", lambda s: (F.least(s + F.col("most"), F.col("end")) - s) < F.col("most") * F.lit(tail))
    first = F.when(F.size("starts") > 1, F.array_min(low))
    rows = rows.withColumn("cut", first.isNotNull()).withColumn("starts", F.when(first.isNotNull(), F.filter("starts", lambda s: s < first)).otherwise(F.col("starts")))
    rows = rows.select("page_id", "end", "most", "cut", F.size("starts").alias("n"), F.posexplode("starts").alias("strip", "y1"))
    bottom = F.when(F.col("cut") & (F.col("strip") == F.col("n") - 1), F.col("end")).otherwise(F.least(F.col("y1") + F.col("most"), F.col("end")))
    return rows.select("page_id", "strip", "y1", bottom.alias("y2"))


def _grid(low: Column, high: Column, most: Column, overlap: int, tail: float) -> Column:
    """Starts along one side; the last start goes if it leaves too little."""
    starts = _starts(low, high, most, overlap)
    short = (F.size(starts) > 1) & ((high - F.element_at(starts, -1)) < most * F.lit(tail))
    return F.when(short, F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(1)))).otherwise(starts)


def tiles(pages: DataFrame, most: Column, overlap: int = OVERLAP, tail: float = TAIL) -> DataFrame:
    """A grid of tiles over each page's content: (page_id, row, col, x1, y1, x2, y2); the last row and column reach to the edge."""
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    rows = pages.where((x2 > x1) & (y2 > y1)).select("page_id", x2.alias("right"), y2.alias("bottom"), most.alias("most"), _grid(x1, x2, most, overlap, tail).alias("xs"), _grid(y1, y2, most, overlap, tail).alias("ys"))
    rows = rows.select("*", F.posexplode("ys").alias("row", "y1")).select("*", F.posexplode("xs").alias("col", "x1"))
    return rows.select(
        "page_id",
        "row",
        "col",
        "x1",
        "y1",
        F.when(F.col("col") == F.size("xs") - 1, F.col("right")).otherwise(F.least(F.col("x1") + F.col("most"), F.col("right"))).alias("x2"),
        F.when(F.col("row") == F.size("ys") - 1, F.col("bottom")).otherwise(F.least(F.col("y1") + F.col("most"), F.col("bottom"))).alias("y2"),
    )


def content_box(boxes: DataFrame, least_area: float = 0.5, least_confidence: float = 0.6) -> DataFrame:
    """The box around a page's text if it is large and sure enough, else the whole page."""
    text = boxes.where("region_type = 'main_text'").groupBy("page_id").agg(
        F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"), F.max("confidence").alias("sure")
    )
    pages = boxes.groupBy("page_id").agg(F.max("page_width").alias("w"), F.max("page_height").alias("h"))
    fits = ((F.col("c") - F.col("a")) * (F.col("d") - F.col("b")) >= F.col("w") * F.col("h") * F.lit(least_area)) & (F.col("sure") >= least_confidence)
    pick = lambda inner, whole: F.when(fits, F.col(inner)).otherwise(whole)
    joined = pages.join(text, "page_id", "left")
    return joined.select("page_id", pick("a", F.lit(0)).alias("x1"), pick("b", F.lit(0)).alias("y1"), pick("c", F.col("w")).alias("x2"), pick("d", F.col("h")).alias("y2"))


#: Ranges of the order over which runs are numbered apart.
RUN_SLICES = 1024


def runs(rows: DataFrame, keys: list[str], order: str, same: list[str], slices: int = RUN_SLICES) -> DataFrame:
    """Number of the run of consecutive rows with equal values. The order is a number, different in each row of a group.

    Runs are numbered within ranges of the order; where a range begins, and how many runs lie before it, comes from one row per group and range,
    so that a group of any size is never sorted in one task.
    """
    span = rows.agg(F.min(order).alias("_low"), ((F.max(order) - F.min(order)) / slices + 1).alias("_width"))
    cut = rows.crossJoin(F.broadcast(span)).withColumn("_slice", F.floor((F.col(order) - F.col("_low")) / F.col("_width"))).drop("_low", "_width")  # one row
    values = F.struct(*same)
    window = Window.partitionBy(*keys, "_slice").orderBy(order)
    before = F.lag(values).over(window)
    marked = cut.withColumn("_new", F.when(before.isNotNull() & ~values.eqNullSafe(before), 1).otherwise(0))
    edges = marked.groupBy(*keys, "_slice").agg(F.sum("_new").alias("_inner"), F.min_by(values, order).alias("_first"), F.max_by(values, order).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_slice")  # `slices` rows at most
    edges = edges.withColumn("_begins", F.when(F.lag("_last").over(along).eqNullSafe(F.col("_first")), 0).otherwise(1))
    edges = edges.withColumn("_base", F.sum(F.col("_inner") + F.col("_begins")).over(along) - F.col("_inner"))
    joined = marked.join(edges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_at"), "_base"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_slice") == F.col("_at")])
    numbered = joined.withColumn("run", F.col("_base") + F.sum("_new").over(window))
    return numbered.drop("_slice", "_new", "_base", "_at", *[f"_{k}" for k in keys])


def runs_of_pages(rows: DataFrame, keys: list[str], order: str, same: list[str]) -> DataFrame:
    """W5 for groups that are small, such as the blocks of one page: each is ordered as a whole."""
    window = Window.partitionBy(*keys).orderBy(order)
    values = F.struct(*same)
    before = F.lag(values).over(window)
    return rows.withColumn("_new", F.when(before.isNotNull() & values.eqNullSafe(before), 0).otherwise(1)).withColumn("run", F.sum("_new").over(window)).drop("_new")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Text of a page from its blocks in order: strips of one region one below the other, margins as markers, blank ones left out."""
    text = F.trim(F.col("text"))
    numbered = runs_of_pages(blocks, ["page_id"], "place", ["region_type", "confidence"])
    merged = numbered.groupBy("page_id", "run").agg(
        F.first("region_type").alias("region_type"), F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]).alias("l")
    )
    body = F.trim(F.array_join("l", "\n"))
    block = F.when(F.col("region_type") == "margin", F.concat(F.lit("[margen: "), body, F.lit("]"))).otherwise(body)
    rows = merged.where(body != "").select("page_id", F.struct("run", block.alias("t")).alias("b"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "\n").alias("text"))


def region_lines(boxes: DataFrame) -> DataFrame:
    """A line per box of a page, numbered from 0 in its order: what it is, how sure, where, how large. Halves are rounded to even."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = w * h / (F.col("page_width") * F.col("page_height")) * 100
    line = F.concat(
        F.format_string("Region %d: type=%s, confidence=%.0f", F.col("place") - 1, F.col("region_type"), F.bround(F.col("confidence") * 100, 0)),
        F.format_string("%%, position=(%d,%d)-(%d,%d), size=%dx%d, area=%.1f", *BOX, w, h, F.bround(share, 1)),
        F.lit("%"),
    )
    return boxes.select("page_id", "place", line.alias("line"))


def quality_badge(width: Column, height: Column, has_image: Column, has_text: Column) -> Column:
    """error without picture or ground truth, a warning below one megapixel, else ok."""
    mega = width.cast("double") * height / F.lit(1_000_000)
    return F.when(~has_image | ~has_text, "error").when(mega < 1.0, "warn").otherwise("ok")


def parse_decisions(text: Column, boxes: Column) -> Column:
    """per box (action, detail) of lines "number: transcribe | skip | merge number"; a box without a line that can be read is transcribed."""
    pattern = r"(?iu)^\s*(\d+)\s*:\s*(transcribe|skip|merge)\b\s*(\d*)"
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern))
    said = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(lines, lambda line: F.regexp_extract(line, pattern, 1).cast("int"))),
            lambda n: F.struct(n, F.element_at(F.filter(lines, lambda line: F.regexp_extract(line, pattern, 1).cast("int") == n), -1)),
        )
    )
    return F.transform(
        F.sequence(F.lit(0), F.greatest(boxes - 1, F.lit(0))),
        lambda i: F.struct(
            i.alias("box"),
            F.coalesce(F.lower(F.regexp_extract(said[i], pattern, 2)), F.lit("transcribe")).alias("action"),
            F.coalesce(F.regexp_extract(said[i], pattern, 3), F.lit("")).alias("detail"),
        ),
    )
