"""Problem 5: splits that keep related records together.

Documents are vertices; edges tie documents of one page, and the different writings of one identifier, to the smallest
document of their group, so that a group of any size gives one edge per member. Components come from random-mate
contraction: each round, vertices draw a side by a coin, those on one side are collapsed into a neighbour on the other,
and edges are carried over; once no edge is left the collapses are unwound by pointer doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.llm.shared import Tables, cut, unit_interval

#: Random-mate contraction ends after a number of rounds in proportion to the logarithm of the vertices; this only stops a fault.
MOST_ROUNDS = 200
#: Slices of the order in which components are dealt out; sums per slice are all that one task sees of the whole.
DEFAULT_SLICES = 1024


def identifier_key(doc_id: Column) -> Column:
    """What an identifier says whatever its writing: its letters, its number without leading zeros, its date.

    Null where there is no number. ``CODEA-0007``, ``codea 7`` and ``CODEA_00000007`` are one, and so are
    ``0227_1675-05-22``, ``227 1675.05.22`` and ``0227_16750522``.
    """
    flat = F.lower(F.regexp_replace(doc_id, r"[^\p{L}0-9]+", " "))
    flat = F.trim(flat)
    dated = r"^(\p{L}*) ?0*([0-9]+?) ([0-9]{4}) ?([0-9]{2}) ?([0-9]{2})$"
    plain = r"^(\p{L}+) ?0*([0-9]+)$"
    return (
        F.when(
            flat.rlike(dated),
            F.concat_ws("|", *(F.regexp_extract(flat, dated, i) for i in range(1, 6))),
        )
        .when(flat.rlike(plain), F.concat_ws("|", F.regexp_extract(flat, plain, 1), F.regexp_extract(flat, plain, 2)))
        .otherwise(F.lit(None).cast("string"))
    )


def _star(members: DataFrame, group: str) -> DataFrame:
    """(doc_id, hub): each member of a group with the group's smallest document; the smallest itself is left out."""
    hubs = members.groupBy(group).agg(F.min("doc_id").alias("hub"))
    return members.join(hubs, group).where("doc_id <> hub").select("doc_id", "hub")


def related_edges(rows: DataFrame, doc: str = "doc_id", page: str = "page_id") -> DataFrame:
    """Edges (a, b), a < b, distinct, whose components are the sets of related documents. Null pages relate nothing."""
    pairs = rows.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_id")).where("doc_id IS NOT NULL").distinct()
    pages = _star(pairs.where("page_id IS NOT NULL"), "page_id")
    written = pairs.select("doc_id").distinct().withColumn("key", identifier_key(F.col("doc_id"))).where("key IS NOT NULL")
    edges = pages.unionByName(_star(written, "key"))
    return edges.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def _coin(vertex: Column | str, turn: int, seed: int) -> Column:
    return (F.xxhash64(F.lit(seed), F.lit(turn), vertex) % 2) == 0


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """(vertex, component) of every vertex that has an edge; the component is named by one of its vertices.

    Random-mate contraction. The coin of a vertex is a hash of its name and the round, so a lost task draws it again alike.
    Each round is written to the shared folder before the next, so that no plan grows with the rounds.
    Self-loops and repeated edges are dropped; an empty table gives an empty one.
    """
    tables = Tables(edges.sparkSession)
    left = tables.keep(edges.select("a", "b").where("a <> b").distinct())
    collapsed: list[DataFrame] = []
    turn = 0
    while not left.isEmpty():
        if turn >= MOST_ROUNDS:
            raise RuntimeError("the contraction did not end")
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mates = tables.keep(both.where(_coin("a", turn, seed) & ~_coin("b", turn, seed)).groupBy("a").agg(F.min("b").alias("into")))
        collapsed.append(mates)
        moved = left
        for side in ("a", "b"):
            step = mates.select(F.col("a").alias("from_vertex"), "into")
            moved = moved.join(step, F.col(side) == F.col("from_vertex"), "left").withColumn(side, F.coalesce("into", side)).select("a", "b")
        left = tables.keep(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    if not collapsed:
        return left.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    links = tables.keep(reduce(DataFrame.unionByName, [x.select(F.col("a").alias("vertex"), "into") for x in collapsed]))
    depth = 1
    while depth < turn:  # after k doublings a pointer spans 2^k collapses
        ahead = links.select(F.col("vertex").alias("into"), F.col("into").alias("further"))
        links = tables.keep(links.join(ahead, "into", "left").select("vertex", F.coalesce("further", "into").alias("into")))
        depth *= 2
    roots = links.select(F.col("into").alias("vertex")).distinct().withColumn("into", F.col("vertex"))
    return tables.last(links.unionByName(roots).select("vertex", F.col("into").alias("component")))


def related_classes(rows: DataFrame, doc: str = "doc_id", page: str = "page_id", seed: int = 7) -> DataFrame:
    """(doc_id, component) of every document; one that is related to none is a component of its own."""
    found = components(related_edges(rows, doc, page), seed).withColumnRenamed("vertex", "doc_id")
    every = rows.select(F.col(doc).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def related_pairs(rows: DataFrame, doc: str = "doc_id", page: str = "page_id", seed: int = 7) -> DataFrame:
    """Pairs (doc_a, doc_b), doc_a < doc_b in code point order, that must not be separated."""
    found = components(related_edges(rows, doc, page), seed)
    a = found.select("component", F.col("vertex").alias("doc_a"))
    b = found.select("component", F.col("vertex").alias("doc_b"))
    return a.join(b, "component").where("doc_a < doc_b").select("doc_a", "doc_b")


def assign_splits(
    rows: DataFrame,
    targets: DataFrame,
    doc: str = "doc_id",
    page: str = "page_id",
    seed: int = 7,
    slices: int = DEFAULT_SLICES,
    heavy_permille: int = 1,
) -> DataFrame:
    """(doc_id, component, split_name): whole components, in about the proportions of ``targets``, by number of pages.

    Components of more than ``heavy_permille`` of all pages, of which there are at most 1000 / heavy_permille, go one by one to
    the split that lacks most; the rest are laid end to end in random order and cut where the cumulative weight meets what
    the splits still lack. Rows without a document are in no split. Without rows, or without targets, nothing is assigned.
    """
    classes = cut(related_classes(rows, doc, page, seed))
    pages = rows.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_id")).where("doc_id IS NOT NULL").distinct()
    per_doc = pages.groupBy("doc_id").agg(F.count("*").alias("weight"))
    weights = cut(classes.join(per_doc, "doc_id").groupBy("component").agg(F.sum("weight").alias("weight")))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    wanted = targets.select("split_name", "target_permille").orderBy(F.desc("target_permille"), "split_name").collect()
    if not total or not wanted:
        return classes.withColumn("split_name", F.lit(None).cast("string")).limit(0)
    scale = sum(t.target_permille for t in wanted)
    lack = {t.split_name: total * t.target_permille / scale for t in wanted}
    bar = total * heavy_permille / 1000
    heavy = weights.where(F.col("weight") > bar).orderBy(F.desc("weight"), "component").collect()
    placed: list[tuple[str, str]] = []
    for component in heavy:
        split = max(lack, key=lambda name: lack[name])
        placed.append((component.component, split))
        lack[split] -= component.weight
    light = weights.where(F.col("weight") <= bar).withColumn("draw", unit_interval("component", seed=seed))
    light = light.withColumn("slice", F.floor(F.col("draw") * slices).cast("int"))
    sums = light.groupBy("slice").agg(F.sum("weight").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(Window.orderBy("slice")) - F.col("own")).drop("own")  # `slices` rows at most
    inside = Window.partitionBy("slice").orderBy("draw", "component")
    light = light.join(F.broadcast(before), "slice")  # `slices` rows at most
    middle = F.col("before") + F.sum("weight").over(inside) - F.col("weight") / 2
    rest = {name: max(0.0, amount) for name, amount in lack.items()}
    open_weight = sum(rest.values()) or 1.0
    light_total = total - sum(c.weight for c in heavy)
    bounds, reached = [], 0.0
    for t in wanted:
        reached += rest[t.split_name] / open_weight * light_total
        bounds.append((reached, t.split_name))
    split = F.lit(bounds[-1][1])
    for bound, name in reversed(bounds[:-1]):
        split = F.when(F.col("middle") <= bound, F.lit(name)).otherwise(split)
    dealt = light.withColumn("middle", middle).select("component", split.alias("split_name"))
    if placed:
        dealt = dealt.unionByName(rows.sparkSession.createDataFrame(placed, "component string, split_name string"))
    return classes.join(dealt, "component").select("doc_id", "component", "split_name")
