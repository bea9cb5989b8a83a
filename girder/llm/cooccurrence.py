"""p5: joint counts of item pairs over baskets, by heavy-light decomposition.

An item is heavy if it occurs in at least 1/HEAVY of all baskets; so there are at most HEAVY times the
mean basket size of them, however many items exist. Pairs of heavy items are counted as popcounts of
AND-ed bit rows over a block of baskets, pairs of light items by hashing, and mixed pairs by probing
the bit rows at the baskets of each light item. Every part is summed within the task first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HEAVY = 64
#: Distinct light pairs held by a task before it passes their counts on.
HELD_PAIRS = 500_000


def item_counts(baskets: DataFrame, items: str) -> DataFrame:
    """(item, rows): in how many baskets each item occurs; null items are none, repeats count once."""
    return baskets.select(F.explode(F.array_distinct(items)).alias("item")).where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("rows"))


def _counted(heavy: list[str]):
    heavy_items = pa.array(heavy, pa.string())
    h = len(heavy)

    def batch_out(pairs: Counter) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(pairs.values(), pa.int64())], ["item_a", "item_b", "joint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((h, h), np.int64)
        light: Counter = Counter()
        for batch in batches:
            lists = batch.column(0)
            n = len(lists)
            values = lists.flatten()
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(values, heavy_items), -1).to_numpy(zero_copy_only=False)
            present = pc.is_valid(values).to_numpy(zero_copy_only=False)
            bits = np.zeros((h, n), bool)
            bits[code[code >= 0], row[code >= 0]] = True
            if h:
                packed = np.packbits(bits, axis=1)
                packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
                for i in range(h):
                    dense[i, i:] += np.bitwise_count(packed[i] & packed[i:]).sum(axis=1, dtype=np.int64)
            rare = (code < 0) & present
            if rare.any():
                names = values.filter(pa.array(rare)).to_pylist()
                baskets: dict[int, set[str]] = {}
                for r, name in zip(row[rare].tolist(), names, strict=True):
                    baskets.setdefault(r, set()).add(name)
                for r, found in baskets.items():
                    ordered = sorted(found)
                    probed = [heavy[i] for i in np.flatnonzero(bits[:, r])]
                    for i, a in enumerate(ordered):
                        light.update((a, b) for b in ordered[i + 1 :])
                        light.update((a, b) if a < b else (b, a) for b in probed)
                        if len(light) > HELD_PAIRS:
                            yield batch_out(light)
                            light = Counter()
        for i, j in zip(*np.nonzero(np.triu(dense, 1)), strict=True):
            a, b = sorted((heavy[i], heavy[j]))
            light[a, b] += int(dense[i, j])
        yield batch_out(light)

    return count


def pair_counts(baskets: DataFrame, items: str, heavy: int = HEAVY) -> DataFrame:
    """(item_a, item_b, joint, rows_a, rows_b, baskets, lift) of all pairs that occur together, item_a < item_b.

    `baskets` counts every row of the input, also those with a null or empty list; lift is
    joint * baskets / (rows_a * rows_b). Null items and repeats within a basket don't count. Texts are
    ordered by code point. An empty input gives no rows.
    """
    lists = cut_lineage(baskets.select(F.col(items).alias("items")))  # written once, read for the size, the items and the pairs
    n = lists.count()
    counts = cut_lineage(item_counts(lists, "items"))
    frequent = [r["item"] for r in counts.where(F.col("rows") * heavy >= n).select("item").collect()]
    pairs = (
        lists.where(F.size("items") > 1)
        .mapInArrow(_counted(sorted(frequent)), "item_a STRING, item_b STRING, joint BIGINT")
        .groupBy("item_a", "item_b")
        .agg(F.sum("joint").alias("joint"))
    )
    a = counts.select(F.col("item").alias("item_a"), F.col("rows").alias("rows_a"))
    b = counts.select(F.col("item").alias("item_b"), F.col("rows").alias("rows_b"))
    lift = F.col("joint") * F.lit(float(n)) / (F.col("rows_a").cast("double") * F.col("rows_b"))
    return pairs.join(a, "item_a").join(b, "item_b").select("item_a", "item_b", "joint", "rows_a", "rows_b", F.lit(n).cast("bigint").alias("baskets"), lift.alias("lift"))
