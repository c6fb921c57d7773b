"""Units of work of bounded size: rows of equal keys that stand together in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(members: DataFrame, keys: list[str], member: str, size: str, block: int) -> DataFrame:
    """``members`` of groups as units (``keys``, i, j): every pair of a group's blocks of ``block`` rows.

    ``size``: the column that holds the group's rows. A member's block is a hash of ``member``. In
    a unit with i = j all rows have side 0; otherwise side tells the two blocks apart. A group of
    n rows makes n * n / block rows and never one unit of n rows.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = members.withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64(member, *keys), F.col("__blocks")).cast("int"))
    each = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low: Column = F.least("__own", "__other")
    return each.withColumn("i", low).withColumn("j", F.greatest("__own", "__other")).withColumn("side", (F.col("__own") > F.col("__other")).cast("int")).drop("__blocks", "__own", "__other")


def together(rows: DataFrame, keys: list[str], tasks: int = 0) -> DataFrame:
    """The rows of a unit next to each other in one task; ``keys`` become the first columns.

    A unit's work is far more than its bytes, so its partitions are not to be merged by their
    size: as many are asked for as the work takes by ``tasks``, or as the session has for
    shuffles if those are more.
    """
    parts = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*keys, *(c for c in rows.columns if c not in keys)).repartition(parts, *keys).sortWithinPartitions(*keys)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows whose first ``keys`` columns (integers) are equal."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)], axis=1)
        edges = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1).tolist(), len(heads)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            head = heads[a].tolist()
            if held and head != now:
                yield pa.Table.from_batches(held)
                held = []
            now = head
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each row the smallest id that the symmetric matrix ``linked`` connects it with."""
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before = root
        root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
    return root
