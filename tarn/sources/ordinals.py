"""Dense row numbers without putting all rows into one task: by a sort order, or by the order in files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.readers import kept, offsets


def in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: numbers from 0 by ``order`` ascending, nulls first; rows equal in it in any order.

    Rows are sorted in ranges and written with their place; a range's first number is the size of
    the ranges before it.
    """
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    piece = F.shiftright("__at", 33)
    met = ranged.join(F.broadcast(offsets(ranged, [piece], F.col("__at"))), piece == F.col("p0"))
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col("__at") + F.col("shift")).alias(name))


def in_file_order(df: DataFrame, name: str = "row") -> DataFrame:
    """The rows of files as read (no filter yet) with ``name``: numbers from 0 by file name and place in the file.

    A first pass counts the rows of each split of a file, a second one adds what the splits before
    it hold; the table of splits is broadcast, some 100 bytes for each 128 MB read. Files must not
    change between both.
    """
    placed = df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    splits = offsets(placed, [F.col("__path"), F.col("__start")], F.col("__at"))
    met = placed.join(F.broadcast(splits), (F.col("__path") == F.col("p0")) & (F.col("__start") == F.col("p1")))
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col("__at") + F.col("shift")).alias(name))
