"""Problem 1: a sample of documents whose shares by cell meet given targets.

Rows become (document, cells) once. Documents with the same set of cells form a stratum; how many documents each stratum gives
to each cell is a flow over the counts, such that no cell lacks documents that it could have. Each document is
accepted independently with its stratum's probability, raised a little; counts are corrected exactly afterwards, from counts
per slice of the unit interval, so a stratum that holds a third of all documents is never gathered in one task.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escriba.llm.shared import cut, unit_interval

#: One document of so many is wanted in the sample.
DEFAULT_FRACTION_DIVISOR = 5
#: Acceptance probabilities are raised by this share, so that a cell seldom needs a second draw.
DEFAULT_OVERSAMPLING = 0.1
#: Slices of the unit interval that are counted per cell; only the slice holding the cut is ranked.
DEFAULT_SLICES = 4096

#: Wanted cells beyond which a target table is refused: what strata give to cells is found on the driver.
CELL_LIMIT = 100_000

CENTURIES = ("XV", "XVI", "XVII")


def century(siglo: Column) -> Column:
    """Century of a stored value: XV, XVI or XVII as written, else by the year in its first four characters, else null."""
    year = F.when(siglo.rlike(r"^[0-9]{4}"), F.substring(siglo, 1, 4).cast("int"))
    return (
        F.when(siglo.isin(*CENTURIES), siglo)
        .when(year < 1500, F.lit("XV"))
        .when(year < 1600, F.lit("XVI"))
        .when(year.isNotNull(), F.lit("XVII"))
    )


def cell_members(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (siglo, letra_normalized, doc_id) of the rows that fall in a wanted cell.

    Null documents belong to no cell. ``targets`` is one row per cell, a table of fixed size.
    """
    rows = manifest.select(
        "doc_id", century(F.col("siglo")).alias("siglo"), "letra_normalized"
    ).where("doc_id IS NOT NULL AND siglo IS NOT NULL AND letra_normalized IS NOT NULL")
    wanted = targets.select("siglo", "letra_normalized").distinct()
    return rows.join(wanted, ["siglo", "letra_normalized"], "left_semi").distinct()


def sample_size(manifest: DataFrame, divisor: int = DEFAULT_FRACTION_DIVISOR) -> DataFrame:
    """One row (n_docs, n): distinct documents and the number wanted in the sample."""
    return manifest.agg(F.countDistinct("doc_id").alias("n_docs")).select(
        "n_docs", F.floor(F.col("n_docs") / F.lit(divisor)).cast("long").alias("n")
    )


def cell_needs(manifest: DataFrame, targets: DataFrame, members: DataFrame, divisor: int = DEFAULT_FRACTION_DIVISOR) -> DataFrame:
    """Per cell of ``targets``: what it needs, what it has, and what it lacks."""
    have = members.groupBy("siglo", "letra_normalized").agg(F.count("*").alias("available"))
    return (
        targets.crossJoin(F.broadcast(sample_size(manifest, divisor)))  # one row
        .join(have, ["siglo", "letra_normalized"], "left")
        .select(
            "siglo",
            "letra_normalized",
            "target_permille",
            "min_docs",
            F.greatest(
                F.col("min_docs").cast("long"), F.floor(F.col("target_permille").cast("long") * F.col("n") / F.lit(1000)).cast("long")
            ).alias("needed"),
            F.coalesce("available", F.lit(0).cast("long")).alias("available"),
            "n",
        )
        .withColumn("deficit", F.greatest(F.col("needed") - F.col("available"), F.lit(0).cast("long")))
    )


def unmet_cells(manifest: DataFrame, targets: DataFrame, divisor: int = DEFAULT_FRACTION_DIVISOR) -> DataFrame:
    """Cells with fewer documents than they need, with the deficit."""
    members = cell_members(manifest, targets)
    return cell_needs(manifest, targets, members, divisor).where("deficit > 0")


def quotas(needs: dict[str, int], strata: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], dict[str, int]]:
    """How many documents each stratum (a set of cells, and how many documents have just these) gives to each of its cells.

    Cells are first filled in proportion to the strata that have them. Then further documents are found along augmenting paths (a
    stratum gives one cell more, for which another stratum takes over elsewhere) until none is left: a largest flow.
    """
    given: dict[tuple[str, ...], dict[str, int]] = {s: dict.fromkeys(s, 0) for s in strata}
    left = dict(strata)
    lack = dict(needs)
    have: dict[str, list[tuple[str, ...]]] = {c: [] for c in needs}
    for s in sorted(strata):
        for c in s:
            have[c].append(s)
    for c in sorted(needs, key=lambda c: (sum(strata[s] for s in have[c]) / max(1, needs[c]), c)):  # scarce cells first
        free = sum(left[s] for s in have[c])
        wanted = min(free, lack[c])
        for s in have[c]:
            n = min(left[s], wanted * left[s] // free if free else 0)
            given[s][c], left[s], lack[c] = n, left[s] - n, lack[c] - n
    for c in sorted(needs):
        while lack[c]:
            came: dict[str, tuple[str, tuple[str, ...]] | None] = {c: None}
            queue, source = deque([c]), None
            while queue and source is None:
                cell = queue.popleft()
                for s in have[cell]:
                    if left[s]:
                        source = (cell, s)
                        break
                    for other in s:  # s gives to another cell what this one could have, if that finds a replacement
                        if other not in came and given[s][other]:
                            came[other] = (cell, s)
                            queue.append(other)
            if source is None:
                break
            cell, s = source
            path = []
            at = cell
            while (step := came[at]) is not None:
                path.append((at, *step))
                at = step[0]
            amount = min([left[s], lack[c], *(given[via][frm] for frm, _, via in path)])
            left[s] -= amount
            given[s][cell] += amount
            for frm, to, via in path:
                given[via][frm] -= amount
                given[via][to] += amount
            lack[c] -= amount
    return given


def proportional_sample(
    manifest: DataFrame,
    targets: DataFrame,
    divisor: int = DEFAULT_FRACTION_DIVISOR,
    oversampling: float = DEFAULT_OVERSAMPLING,
    slices: int = DEFAULT_SLICES,
    seed: int = 42,
) -> DataFrame:
    """Draw documents for the cells; each document serves one cell, and as many needs are met as can be met at once.

    Each stratum's documents are accepted with probability wanted / observed, raised by ``oversampling``. Where fewer than wanted
    were accepted the rest of the stratum is let in as well; then those with the smallest draws are kept, as many as wanted,
    and dealt to the cells. The draw is a hash of the document, so that a retried task draws it again.

    Nulls: no case. Repeated rows count once, cells that ``targets`` repeats have the greatest need given. An empty manifest gives an
    empty sample. Extra columns are ignored.
    Columns: siglo, letra_normalized, doc_id, accepted_at_first (false for a document that came in by correction).
    """
    spark = manifest.sparkSession
    members = cell_members(manifest, targets)
    cell = F.to_json(F.struct("siglo", "letra_normalized"))
    docs = cut(members.groupBy("doc_id").agg(F.sort_array(F.collect_set(cell)).alias("cells")).withColumn("draw", unit_interval("doc_id", seed=seed)))
    rows = cell_needs(manifest, targets, members, divisor).groupBy(cell.alias("cell")).agg(F.max("needed").alias("needed")).limit(CELL_LIMIT + 1).collect()
    if len(rows) > CELL_LIMIT:
        raise ValueError(f"more than {CELL_LIMIT} cells are wanted")
    strata = {tuple(r.cells): r.n for r in docs.groupBy("cells").agg(F.count("*").alias("n")).collect()}  # one row per set of wanted cells
    dealt, shares = [], []
    for s, given in quotas({r.cell: r.needed for r in rows}, strata).items():
        total = sum(given.values())
        if total:
            shares.append((list(s), total, min(1.0, total * (1 + oversampling) / strata[s])))
            reached = 0
            for c, n in sorted(given.items()):
                if n:
                    dealt.append((list(s), c, reached, reached + n))
                    reached += n
    wanted = spark.createDataFrame(shares, "cells array<string>, total long, chance double")
    ranges = spark.createDataFrame(dealt, "cells array<string>, cell string, above long, upto long")
    home = docs.join(F.broadcast(wanted), "cells")  # one row per stratum
    first = home.where("draw < chance").groupBy("cells").agg(F.count("*").alias("accepted"))
    home = home.join(F.broadcast(first), "cells", "left")  # one row per stratum
    enough = F.coalesce("accepted", F.lit(0)) >= F.col("total")
    pool = home.where(~enough | (F.col("draw") < F.col("chance"))).withColumn("slice", F.floor(F.col("draw") * slices).cast("int"))
    counts = pool.groupBy("cells", "slice").agg(F.count("*").alias("in_slice"))
    running = Window.partitionBy("cells").orderBy("slice")  # at most `slices` rows a stratum
    counts = counts.withColumn("before", F.sum("in_slice").over(running) - F.col("in_slice")).select("cells", "slice", "before")
    inside = Window.partitionBy("cells", "slice").orderBy("draw", "doc_id")
    ranked = pool.join(counts, ["cells", "slice"]).where("before < total").withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    kept = ranked.where("rank < total").join(F.broadcast(ranges), "cells").where("rank >= above AND rank < upto")  # one row per stratum and cell
    name = F.from_json("cell", "siglo string, letra_normalized string")
    return kept.select(name["siglo"].alias("siglo"), name["letra_normalized"].alias("letra_normalized"), "doc_id", (F.col("draw") < F.col("chance")).alias("accepted_at_first"))


def sample_report(manifest: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Per cell: wanted, available, drawn, and what the sample lacks (``short``).

    A cell is short where it has fewer documents than it needs (``deficit``), or shares them with cells that need them as well.
    """
    divisor = options.get("divisor", DEFAULT_FRACTION_DIVISOR)
    drawn = proportional_sample(manifest, targets, **options).groupBy("siglo", "letra_normalized").agg(F.count("*").alias("drawn"))
    needs = cell_needs(manifest, targets, cell_members(manifest, targets), divisor)
    return (
        needs.join(drawn, ["siglo", "letra_normalized"], "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
        .withColumn("short", F.greatest(F.col("needed") - F.col("drawn"), F.lit(0).cast("long")))
    )
