"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, lean
from tarn.llm.components import components
from tarn.llm.units import dealt, roots, runs, together

#: TABLES tables of PROJECTIONS projections, quantised to WIDTH. Two unit vectors at the distance
#: of a cosine of 0.95 (0.316) share a table's bucket with probability 0.053, one of TABLES with
#: 0.998; at a cosine of 0.97 they miss all once in a million. At right angles a table's chance
#: is 3e-7: for far more rows raise PROJECTIONS with the logarithm of their number.
PROJECTIONS, TABLES, WIDTH = 16, 112, 1.5
#: Rows of a bucket that meet in one task: larger buckets are dealt out in pairs of blocks.
BLOCK = 256


@lru_cache(maxsize=4)
def _tables(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(90210 + dims))
    return (
        draw.standard_normal((dims, TABLES * PROJECTIONS)),
        draw.uniform(0, WIDTH, TABLES * PROJECTIONS),
        draw.integers(1, 2**63, PROJECTIONS, dtype=np.uint64) | np.uint64(1),
    )


def _keys(unit: np.ndarray) -> np.ndarray:
    """Bucket numbers (vectors, TABLES) of unit vectors."""
    project, shift, factors = _tables(unit.shape[1])
    cells = np.floor((unit @ project + shift) / WIDTH).astype(np.int64).view(np.uint64)
    mixed = (cells.reshape(len(unit), TABLES, PROJECTIONS) * factors).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to unit length in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _linked(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, unit: np.ndarray, keys: np.ndarray, t: int, inside: bool, least: float) -> list[tuple[int, int, int]]:
    """(id, links, smallest id connected here) of the members with links first met in table ``t``.

    ``inside``: all pairs of one block; otherwise pairs across the two sides.
    """
    a, b = (np.arange(len(ids)),) * 2 if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(a) or not len(b):
        return []
    met = unit[a] @ unit[b].T >= least
    for earlier in range(t):
        met &= keys[a, earlier][:, None] != keys[b, earlier][None, :]
    met &= keys[a, t][:, None] == keys[b, t][None, :]
    if inside:
        np.fill_diagonal(met, False)
    if not met.any():
        return []
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, a, met @ copies[b])
    if not inside:
        np.add.at(links, b, met.T @ copies[a])
    full = np.zeros((len(ids), len(ids)), dtype=bool)
    full[np.ix_(a, b)] |= met
    full |= full.T
    root = roots(ids, full)
    return [(int(ids[i]), int(links[i]), int(root[i])) for i in np.flatnonzero(links)]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id and kept.

    Two vectors are linked if their cosine in double precision is at least ``least`` and some
    table puts both in one bucket. n_links counts the other rows linked directly, component_id is
    the smallest id that links reach. Vectors that are null, empty, zero or hold null or
    non-finite numbers, and vectors of different lengths, are linked with nothing; a row with a
    null id has no links, a null component and is kept; rows that repeat an id count as rows. An
    empty table gives an empty one; other columns are ignored, whatever their names.

    Equal vectors are one representative with a number of copies. The members of a bucket are
    dealt to blocks of about BLOCK rows; every pair of blocks is a unit of work whose cosines are
    one matrix product. A pair of vectors counts only in the first table where both share a
    bucket. A unit returns a row per linked member (its links, and the smallest member it is
    connected with there), so large groups never become pairs.
    """
    # vectors travel in the precision they are stored in; cosines are taken in double precision
    stored = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(stored).alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    reps = cut(rows.where(good).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.size("v").alias("dims")).where("dims > 0"))

    def keyed(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    keys = _keys(_matrix(some.column(1)))
                    flat = pa.array(keys.reshape(-1))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * TABLES), flat)], names=["rep", "keys"])

    buckets = reps.select("rep", "v", "dims").mapInArrow(lean(keyed), "rep long, keys array<long>")
    placed = buckets.join(reps.select("rep", "dims"), "rep").select("rep", "dims", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy("dims", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt(placed.join(sizes, ["dims", "t", "key"]), ["dims", "t", "key"], "rep", "n", BLOCK)
    work = together(met.select("t", "key", "i", "j", "side", "rep").join(reps, "rep"), ["t", "key", "i", "j", "dims"])

    def linked(batches):
        found = []
        for unit in runs(batches, 5):
            ids, copies, side = (unit.column(c).to_numpy() for c in ("rep", "copies", "side"))
            if len(ids) > 1:
                matrix = _matrix(unit.column("v").combine_chunks())
                first = unit.slice(0, 1).to_pylist()[0]
                found += _linked(ids, copies, side, matrix, _keys(matrix), first["t"], first["i"] == first["j"], least)
            if len(found) > 10_000:
                yield out(found)
                found = []
        yield out(found)

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["rep", "links", "root"])

    found = cut(work.mapInArrow(lean(linked), "rep long, links long, root long").groupBy("rep", "root").agg(F.sum("links").alias("links")))
    whole = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        reps.join(counts, "rep", "left")
        .join(whole.withColumnRenamed("id", "rep"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.withColumn("v", F.when(good, F.col("v"))).join(classes, "v", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


#: DuckDB SQL for ``near_duplicates`` of the embeddings: all pairs.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
s AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x AS id, x AS top FROM s UNION SELECT s.y, r.top FROM r JOIN s ON s.x = r.id),
c AS (SELECT id, min(top) AS top FROM r GROUP BY id),
n AS (SELECT x AS id, count(*) AS k FROM s GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(top, vec_id) AS component_id, coalesce(coalesce(top, vec_id) = vec_id, true) AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""
