"""Concordant pairs within groups of any size, counted without making pairs.

With a group's rows in order of gold, and of descending value among equals, a pair
is concordant where an earlier row has the smaller value: pairs with equal gold
never count. Groups that lie in one partition of that order are counted there. Of
larger ones each partition, a block, counts its own pairs. The others, between two
blocks, are counted through a second order, by value, whose partitions are buckets:

* two rows in different buckets: from the numbers of rows in each block and bucket,
  the earlier block with the lower bucket;
* two rows in one bucket: the bucket's own concordant pairs, without those that
  lie in one block, which that block has counted.

Rows move twice, whatever the group's size, and nothing is copied. Equal values lie
in the second order so that a cut between them makes no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.sources.tables import staged

from .windows import segments


def ascents(values: np.ndarray) -> int:
    """How many pairs have the smaller value first; by halving the range of ranks, level by level."""
    if len(values) < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        # rows of one half of the range, in their order
        by = np.argsort(rank >> (bit + 1), kind="stable")
        group, upper = (rank >> (bit + 1))[by], (rank >> bit & 1)[by]
        lower_before = np.cumsum(1 - upper)
        start = np.searchsorted(group, group, side="left")
        before = lower_before - np.where(start > 0, lower_before[np.maximum(start - 1, 0)], 0)
        total += int((before * upper).sum())
    return total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, ...) with their values last, and the block's count at its last row."""
    for table in segments(batches, 2):
        counts = np.zeros(table.num_rows, np.int64)
        counts[-1] = ascents(table.column(table.num_columns - 1).to_numpy())
        yield from table.append_column("pairs", pa.array(counts)).combine_chunks().to_batches()


def concordant(df: DataFrame, group: str, gold: list[str], value: str, item: str) -> DataFrame:
    """(group, pairs): rows of a group that its gold columns, in their order, and its value order the same way.

    Rows with a null or NaN value make no pairs; null groups are none. ``item`` orders rows that are equal otherwise.
    """
    x = F.col(value).cast("double")
    names = [f"g{i}" for i in range(len(gold))]
    rows = df.filter(F.col(group).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(F.col(group).alias("group"), *(F.col(c).alias(n) for c, n in zip(gold, names, strict=True)), F.col(item).alias("item"), x.alias("x"))
    first = ["group", *names, F.desc("x"), "item"]
    ordered = rows.repartitionByRange(*first).sortWithinPartitions(*first).select(F.xxhash64("group").alias("key"), F.spark_partition_id().alias("block"), "group", *names, "item", "x")
    schema = T.StructType([*ordered.schema.fields, T.StructField("pairs", T.LongType())])
    blocks = staged(ordered.mapInArrow(_blocks, schema), "blocks")
    own = blocks.groupBy("group").agg(F.sum("pairs").alias("pairs"), F.count_distinct("block").alias("n"))

    # groups in several blocks, at most two a partition
    wide = blocks.join(F.broadcast(own.filter("n > 1").select("group")), "group", "left_semi").drop("pairs")
    second = ["group", "x", *(F.desc(n) for n in names), F.desc("item")]
    dealt = wide.repartitionByRange(*second).sortWithinPartitions(*first).select("key", F.spark_partition_id().alias("bucket"), "block", "x")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in segments(batches, 2):
            block, values = table.column(2).to_numpy(), table.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            counts = np.array([ascents(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], np.int64)
            more = -counts
            more[0] += ascents(values)
            key, bucket = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            n = len(counts)
            cols = [pa.array([key] * n, pa.int64()), pa.array([bucket] * n, pa.int32()), pa.array(block[cuts[:-1]], pa.int32()), pa.array(np.diff(cuts), pa.int64()), pa.array(more)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "bucket", "block", "n", "pairs"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each key's cells are at most the square of the number of partitions."""
        for table in segments(batches, 1):
            block, bucket = (np.unique(table.column(i).to_numpy(), return_inverse=True)[1] for i in (2, 1))
            grid = np.zeros((block.max() + 1, bucket.max() + 1), np.int64)
            np.add.at(grid, (block, bucket), table.column(3).to_numpy())
            before = np.zeros_like(grid)
            before[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
            pairs = int((grid * before).sum()) + int(table.column(4).to_numpy().sum())
            yield pa.RecordBatch.from_arrays([pa.array([table.column(0)[0].as_py()], pa.int64()), pa.array([pairs], pa.int64())], names=["key", "more"])

    counted = dealt.mapInArrow(cells, "key long, bucket int, block int, n long, pairs long").repartition("key").sortWithinPartitions("key")
    more = counted.mapInArrow(across, "key long, more long")
    found = own.withColumn("key", F.xxhash64("group")).join(more, "key", "left")
    return found.select(F.col("group").alias(group), (F.col("pairs") + F.coalesce("more", F.lit(0))).alias("pairs"))
