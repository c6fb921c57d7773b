"""Texts as positions into block dictionaries, and the shuffle of the dictionaries by word.

A block holds whole texts of one partition, about BLOCK_BYTES of them. Each text becomes the
positions of its pieces in the block's dictionary of distinct pieces; the dictionary is split
by a hash of the piece into shards. So (piece, block, place) rows of a shard meet in one task, in
packed rows: a piece crosses the network once per block and not once per occurrence, and frequent
pieces cost one entry per block. Blocks are bounded, and there are the more shards the more
partitions of texts there are; nothing else is gathered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.llm.common import lean, release

BLOCK_BYTES = 3 << 20
#: Shards for one partition of texts. Their number grows with the fourth root of the partitions: the
#: pieces of a block are some ten thousands, and rows of a few pieces would cost more than they
#: spread. 100 TB in partitions of 128 MB make 4,096 shards.
SHARDS = 128


def shards_of(df: DataFrame) -> int:
    """The shards for the dictionaries of ``df``'s texts, a power of 2."""
    return 1 << round(math.log2(SHARDS * max(1, df.rdd.getNumPartitions()) ** 0.25))


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, by byte planes."""
    return squeeze(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(packed), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def pack_pieces(pieces: list[bytes]) -> bytes:
    return squeeze(np.array([len(pieces), *map(len, pieces)], dtype="<u4").tobytes() + b"".join(pieces))


def unpack_pieces(packed: bytes) -> list[bytes]:
    raw = expand(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4).astype(np.int64))])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; a batch's binaries are not copied into Python all at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


#: (texts of a block) -> (positions of all pieces, offsets into them by text, distinct pieces, counts of pieces or None)
Cutter = Callable[[pa.Array, pa.RecordBatch], tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray | None]]


def blocked(df: DataFrame, keep: list[str], text: str, cutter: Cutter) -> DataFrame:
    """Rows of texts, rows of blocks and rows of dictionary shards, told apart by ``key``.

    A text's row: key (its block), place (its row in the block), n, and the ``keep`` columns as
    keep0, keep1 and so on, so that they may have any names. A block's
    row: key, positions of all its texts. A shard's row: key (-1 - shard), block, pieces, places,
    counts. The number of a block comes from its partition and from its dictionary, so texts
    never meet the dictionary of other texts, even if a lost partition is read in another order.
    """
    own = T.StructType.fromDDL("key long, block long, place int, n long, positions binary, pieces binary, places binary, counts binary")
    schema = T.StructType(own.fields + [T.StructField(f"keep{i}", df.schema[k].dataType) for i, k in enumerate(keep)])
    shards = shards_of(df)

    def run(batches):
        arrow = _Arrow(schema)
        serial = TaskContext.get().partitionId() << 24
        for batch in gathered(batches, len(keep)):
            texts = batch.column(len(keep))
            texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
            at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            row = 0
            while row < len(texts):
                last = max(row + 1, int(np.searchsorted(at, at[row] + 2 * BLOCK_BYTES, side="right")) - 1)
                part = batch.slice(row, last - row)
                yield from emit(arrow, serial, part, cutter(texts.slice(row, last - row), part))
                row, serial = last, serial + 1

    def emit(arrow, serial, part, made):
        positions, bounds, pieces, counts = made
        block = xxhash.xxh64_intdigest(b"\0".join(pieces), serial & 0xFFFFFFFFFFFFFFFF) >> 1
        n = part.num_rows
        yield arrow.batch(n, {"key": pa.array([block] * n), "place": pa.array(range(n)), "n": pa.array(np.diff(bounds))} | {f"keep{i}": part.column(i) for i in range(len(keep))})
        yield arrow.batch(1, {"key": pa.array([block]), "positions": pa.array([pack_numbers(positions)], pa.binary())})
        shard = np.fromiter((zlib.crc32(p) for p in pieces), dtype=np.uint32, count=len(pieces)) % shards
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        full = [(s, order[edges[s] : edges[s + 1]]) for s in range(shards) if edges[s] < edges[s + 1]]
        columns = {
            "key": pa.array([-1 - s for s, _ in full], pa.int64()),
            "block": pa.array([block] * len(full), pa.int64()),
            "pieces": pa.array([pack_pieces([pieces[i] for i in of.tolist()]) for _, of in full], pa.binary()),
            "places": pa.array([pack_numbers(np.diff(of, prepend=0)) for _, of in full], pa.binary()),
        }
        if counts is not None:
            columns["counts"] = pa.array([pack_numbers(counts[of]) for _, of in full], pa.binary())
        yield arrow.batch(len(full), columns)

    return df.select(*(f"`{k}`" for k in keep), f"`{text}`").mapInArrow(lean(run), schema)


def gathered(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold BLOCK_BYTES of texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= BLOCK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Arrow:
    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)
        self.fields = list(self.schema)

    def batch(self, rows: int, columns: dict) -> pa.RecordBatch:
        """Columns that are not given are null."""
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in self.fields], names=self.schema.names)


def dictionary_rows(blocks: DataFrame) -> DataFrame:
    return blocks.where("key < 0").select("key", "block", "pieces", "places", "counts")


def by_shard(rows: DataFrame, *then: str) -> DataFrame:
    """Rows of a shard in one task, one shard after another."""
    return rows.repartition("key").sortWithinPartitions("key", *then)


def reassembled(rows: DataFrame, parts: DataFrame, keep: list[str], fields: str, made: Callable) -> DataFrame:
    """``keep`` columns and ``fields`` of each text, from the rows of its block and its returned parts.

    ``made(part rows, position arrays)`` gives the values of ``fields`` for the block's texts.
    Rows of shards among ``rows`` are left out. ``keep`` names none of ``fields``.
    """
    made_here = T.StructType.fromDDL(fields).fields
    if {k.lower() for k in keep} & {f.name.lower() for f in made_here}:
        raise ValueError(f"columns to keep must not be named {', '.join(f.name for f in made_here)}")
    schema = T.StructType([T.StructField(k, rows.schema[f"keep{i}"].dataType) for i, k in enumerate(keep)] + made_here)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        arrow = _Arrow(schema)
        texts = left.filter(pc.and_(pc.greater_equal(left.column("key"), 0), pc.is_valid(left.column("n")))).sort_by("place")
        if not texts.num_rows:
            return arrow.schema.empty_table()
        positions = unpack_numbers(left.filter(pc.is_valid(left.column("positions"))).column("positions")[0].as_py())
        if not right.num_rows and len(positions):
            raise ValueError("a block lost its dictionary: the texts were read in another order")
        ends = np.cumsum(texts.column("n").to_numpy())
        values = made(right.to_pylist(), np.split(positions, ends[:-1]))
        columns = [texts.column(f"keep{i}").combine_chunks() for i in range(len(keep))] + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in values]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow.fields, strict=True)], names=arrow.schema.names)

    return rows.groupBy("key").cogroup(parts.groupBy("block")).applyInArrow(run, schema)


def pack_longs(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values, dtype="<i8").tobytes())


def unpack_longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(expand(packed), dtype="<i8")
