"""Problem 6: texts of varying length packed into containers of fixed capacity.

Items are spread over partitions of bounded size by a hash and packed in each by best fit decreasing. Dual feasible
functions give a lower bound of the containers a partition needs; one that meets its bound is certified and done. The
items of the others are dealt anew among each other and packed again, as long as that certifies any more of them.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escriba.llm.shared import cut

#: Items that one partition holds on average.
DEFAULT_PARTITION_ITEMS = 4000


def byte_tokens(text: Column) -> Column:
    """Tokens of a text in the public byte tokenizer: one per UTF-8 byte and one that closes the document."""
    return F.octet_length(text).cast("long") + F.lit(1).cast("long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that the sizes need at least: the best of a family of dual feasible functions.

    The family: the sum over the capacity; the rounding u_k(x) = x if x (k+1) is a multiple of the capacity, else
    floor(x (k+1) / C) C / k; and, for each threshold up to half of the capacity, the function that raises what exceeds C - t to C, keeps
    the middle and drops what is below t. All in whole numbers.
    """
    sizes = np.sort(np.asarray(sizes, dtype=np.int64))
    if not sizes.size:
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        whole = scaled % capacity == 0
        # in units of 1/k: k * u_k(x)
        value = np.where(whole, sizes * k, scaled // capacity * capacity).sum()
        best = max(best, -(-int(value) // (capacity * k)))
    running = np.concatenate([[0], np.cumsum(sizes)])
    for t in np.unique(sizes[sizes * 2 <= capacity]):
        low = np.searchsorted(sizes, t, "left")
        high = np.searchsorted(sizes, capacity - t, "right")
        value = int(running[high] - running[low]) + (sizes.size - high) * capacity
        best = max(best, -(-value // capacity))
    return int(best)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers); items come longest first, ties in the given order."""
    order = np.argsort(-np.asarray(sizes), kind="stable")
    where = np.empty(len(sizes), dtype=np.int64)
    free: list[tuple[int, int]] = []  # sorted (space left, container)
    count = 0
    for item in order:
        size = int(sizes[item])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            space, container = free.pop(at)
        else:
            space, container = capacity, count
            count += 1
        where[item] = container
        if space > size:
            bisect.insort(free, (space - size, container))
    return where, count


def pieces(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Items (key, piece, pieces, tokens): one per text, or as many as needed where a text alone exceeds the capacity.

    Null texts give no item. The pieces of a long text are full but for the last, so their number is the least possible.
    """
    size = byte_tokens(F.col(text))
    items = documents.where(F.col(text).isNotNull()).select(F.col(key), size.alias("size"))
    items = items.withColumn("pieces", F.ceil(F.col("size") / F.lit(capacity)).cast("int"))
    return items.select(key, "pieces", "size", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).select(
        key,
        "piece",
        "pieces",
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity).alias("tokens"),
    )


PACKED = "item bigint, piece int, pieces int, tokens bigint, part int, bin int, bins int, bound int"


def _pack(items: DataFrame, capacity: int, parts: int, turn: int, seed: int) -> DataFrame:
    """Deal the items over ``parts`` partitions by a hash and pack each."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item", "piece", "tokens"], kind="stable")
        sizes = group["tokens"].to_numpy()
        group["bin"], group["bins"] = best_fit_decreasing(sizes, capacity)
        group["bound"] = lower_bound(sizes, capacity)
        return group.astype({"bin": "int32", "bins": "int32", "bound": "int32"})

    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "item", "piece", "tokens", "copy"), F.lit(parts)).cast("int"))
    return dealt.select("item", "piece", "pieces", "tokens", "part").groupBy("part").applyInPandas(pack, PACKED)


def pack_documents(
    documents: DataFrame,
    capacity: int,
    key: str = "doc_id",
    text: str = "text",
    partition_items: int = DEFAULT_PARTITION_ITEMS,
    seed: int = 11,
) -> DataFrame:
    """Every text in a container: (key, piece, pieces, tokens, container, certified).

    ``container`` is a text "round-partition-bin"; ``certified`` tells whether its partition meets the lower bound. Texts are whole
    unless one alone exceeds the capacity. Null texts are left out, the empty text takes one token. Rows that repeat are items of
    their own. Columns other than key and text are ignored. An empty table gives an empty one.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    items = pieces(documents, capacity, key, text).withColumnRenamed(key, "item")
    items = cut(items.withColumn("item", F.col("item").cast("long")).withColumn("copy", F.monotonically_increasing_id()))
    total = items.count()
    columns = ["item", "piece", "pieces", "tokens", "container", "certified"]
    done: list[DataFrame] = []
    turn = 0
    while True:
        parts = max(1, -(-total // partition_items))
        packed = cut(_pack(items, capacity, parts, turn, seed))
        packed = packed.withColumn("container", F.concat_ws("-", F.lit(turn), "part", "bin")).withColumn("certified", F.col("bins") <= F.col("bound"))
        open_ = packed.where("NOT certified")
        left = open_.count()
        if parts == 1 or left in (0, total):  # nothing to exchange, or an exchange that certified none
            done.append(packed.select(*columns))
            break
        done.append(packed.where("certified").select(*columns))
        items = open_.select("item", "piece", "pieces", "tokens", (F.col("part").cast("long") * F.lit(1 << 32) + F.col("bin")).alias("copy"))
        total, turn = left, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("item", key)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, the least number that the sum of tokens allows, and the share of unused space."""
    return packed.agg(
        F.count("*").alias("items"),
        F.countDistinct("container").alias("containers"),
        F.ceil(F.sum("tokens") / F.lit(capacity)).cast("long").alias("least_by_sum"),
        F.sum(F.when(~F.col("certified"), 1).otherwise(0)).cast("long").alias("items_uncertified"),
        F.sum("tokens").alias("tokens"),
    ).withColumn("unused", F.lit(1.0) - F.col("tokens") / (F.col("containers") * F.lit(capacity)))


def capacity_of(spec: DataFrame) -> int:
    """Capacity of the first container of the list."""
    row = spec.orderBy("spec_id").first()
    if row is None:
        raise ValueError("no container is given")
    return int(row.capacity_tokens)


def split_documents(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that had to be split, one row each."""
    return packed.where("pieces > 1").select(key).distinct()
