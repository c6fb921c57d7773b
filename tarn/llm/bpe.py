"""Byte-level BPE encoding by a global shuffle of distinct pieces, and decoding by a token table."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.llm.blocks import blocked, pack_numbers, reassembled, rows_of, unpack_numbers, unpack_pieces
from tarn.llm.common import lean


#: Tokens that are decoded at once, so that a long text's index arrays stay small.
PART = 1 << 16


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@lru_cache(maxsize=2)
def _encoding(path: str):
    """An encoding of whole pieces: its own pattern takes any text as one piece."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, the start and the length of each id (-1: no such id)."""
    ranks = sorted((r, t) for t, r in _ranks(path).items())
    starts = np.zeros(ranks[-1][0] + 1, dtype=np.int64)
    lengths = np.full(ranks[-1][0] + 1, -1, dtype=np.int64)
    at = 0
    for rank, token in ranks:
        starts[rank], lengths[rank] = at, len(token)
        at += len(token)
    return np.frombuffer(b"".join(t for _, t in ranks), dtype=np.uint8), starts, lengths


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts : starts + lengths] one after another."""
    ends = np.cumsum(lengths)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens and ids (array of int) of each row's whole text; null: no ids.

    ``pattern`` splits a text into pieces with positions. The pieces of a block of texts are
    numbered; each distinct piece goes to the task of its hash, which encodes it once; the ids
    return to the blocks that hold the piece and texts are put together by position. ``path``
    is a rank file that every executor can open; special tokens are ordinary text. Empty texts
    have no ids, very long ones are a block of their own. Repeated rows give repeated results; an
    empty table gives an empty one. ``keep`` may have any names but n_tokens and ids.
    """

    def cutter(texts: pa.Array, part: pa.RecordBatch):
        find = regex.compile(pattern).findall
        index: dict[str, int] = {}
        positions, bounds = [], [0]
        for i in range(len(texts)):
            pieces = find(texts[i].as_py())
            for piece in dict.fromkeys(pieces):
                if piece not in index:
                    index[piece] = len(index)
            positions.append(np.fromiter(map(index.__getitem__, pieces), dtype=np.uint32, count=len(pieces)))
            bounds.append(bounds[-1] + len(pieces))
        return np.concatenate(positions), np.array(bounds), [p.encode() for p in index], None

    def encoded(batches):
        encode_piece = _encoding(path).encode_ordinary
        shard, known = None, {}
        for row in rows_of(batches):
            if row["key"] >= 0:
                continue
            if row["key"] != shard:
                shard, known = row["key"], {}
            ids = []
            for piece in unpack_pieces(row["pieces"]):
                if piece not in known:
                    known[piece] = encode_piece(piece.decode())
                ids.append(known[piece])
            lengths = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids))
            flat = np.fromiter((x for one in ids for x in one), dtype=np.uint32, count=int(lengths.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["places"]], pa.binary()), pa.array([pack_numbers(lengths)], pa.binary()), pa.array([pack_numbers(flat)], pa.binary())], names=["block", "places", "lengths", "ids"])

    def joined(parts, positions):
        places = [np.cumsum(unpack_numbers(p["places"])) for p in parts]
        lengths = [unpack_numbers(p["lengths"]).astype(np.int64) for p in parts]
        flat = np.concatenate([unpack_numbers(p["ids"]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int32)
        size = np.concatenate(lengths or [np.zeros(0, np.int64)])
        start, length = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        if len(size):
            at = np.concatenate(places).astype(np.int64)
            start[at], length[at] = np.cumsum(size) - size, size
        made = [_gather(flat, start[p], length[p]) for p in positions]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in made])])
        return [np.diff(bounds), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(made) if made else flat[:0]))]

    # one exchange by key serves both: the shards, which are encoded, and the blocks, which wait for them
    dealt = blocked(docs, keep, text_col, cutter).repartition("key")
    parts = dealt.sortWithinPartitions("key").mapInArrow(lean(encoded), "block long, places binary, lengths binary, ids binary")
    return reassembled(dealt, parts, keep, "n_tokens long, ids array<int>", joined)


def decode(ids: DataFrame, path: str, ids_col: str = "ids", digests: bool = False, keep_ids: bool = False) -> DataFrame:
    """All columns and decoded (binary): the bytes of the tokens of ``ids_col`` in their order.

    Ids are joined to the rank file's token-byte table, which each task holds (its size is the
    vocabulary's). A null list has a null result, an empty one decodes to nothing; an id that the
    table lacks fails the job. Very long lists are decoded in parts of PART ids. Repeated rows give
    repeated results, an empty table an empty one. A given column with a new one's name gives way.
    ``digests``: instead of both columns, ids_sha256 (of the ids as little-endian 32-bit
    integers) and decoded_sha256 in hex; with ``keep_ids`` the ids stay beside them.
    """
    kept = [f for f in ids.schema.fields if keep_ids or not (digests and f.name == ids_col)]
    made = [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")] if digests else [T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([f for f in kept if f.name not in {m.name for m in made}] + made)

    def run(batches):
        flat, starts, lengths = _token_table(path)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_col))
            results = []
            for i in range(batch.num_rows):
                if not column[i].is_valid:
                    results.append((None, None))
                    continue
                one = column[i].values.to_numpy(zero_copy_only=False)
                if len(one) and (one.min() < 0 or one.max() >= len(lengths) or lengths[one].min() < 0):
                    raise ValueError("an id is not in the token table")
                parts = (_gather(flat, starts[p], lengths[p]).tobytes() for p in (one[at : at + PART] for at in range(0, len(one), PART)))
                if digests:
                    whole = hashlib.sha256()
                    for part in parts:
                        whole.update(part)
                    results.append((hashlib.sha256(one.astype("<u4")).hexdigest(), whole.hexdigest()))
                else:
                    results.append((b"".join(parts),))
            new = [pa.array([r[k] for r in results], pa.string() if digests else pa.binary()) for k in range(len(made))]
            old = [batch.column(batch.schema.names.index(n)) for n in schema.names[: -len(new)]]
            yield pa.RecordBatch.from_arrays(old + new, names=schema.names)

    return ids.mapInArrow(lean(run), schema)
