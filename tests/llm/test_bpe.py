import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import bpe
from tarn.llm.blocks import pack_longs, pack_numbers, pack_pieces, unpack_longs, unpack_numbers, unpack_pieces
from tarn.llm.entries import RANKS, op2_byte_bpe
from tests.conftest import DATA


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_matches_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op2_byte_bpe(spark, f"{DATA}/sf0.001").collect()}
    assert got == {i: digests(library, t) for i, t in texts.items()}


def test_edge_texts(spark, library):
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "don't  stop\t\tnow 123 ½ Ⅷ", "   \x1c\x85 a", "🙂👩‍👩‍👧", "x" * 300_000, "ab " * 200_000, "\x00\x01", "é̂ 漢字かな"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(3, "again", "clash"), (None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, ["doc_id"])
    made = bpe.decode(encoded, RANKS).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]).decode()) for r in made if r["doc_id"] is not None) == sorted(
        (False, i, tuple(library.encode_ordinary(t or "")), t or "") for i, t, _ in rows if i is not None
    )
    assert len(made) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in made)
    none = bpe.decode(bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN, ["doc_id"]), RANKS, digests=True)
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decode_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode(spark.createDataFrame([([1, 10**6],)], "ids array<int>"), RANKS).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), RANKS).first()["decoded"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=40), st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_packing_round_trips(pieces, numbers):
    assert unpack_pieces(pack_pieces(pieces)) == pieces
    assert unpack_numbers(pack_numbers(numbers)).tolist() == numbers
    assert unpack_longs(pack_longs(numbers)).tolist() == numbers


def test_any_columns_are_kept(spark, library):
    names = ["key", "n", "place", "block", "positions", "pieces", "places", "counts", "keep0", "text", "a b"]
    df = spark.createDataFrame([tuple(f"{c} {k}" for c in names) for k in range(5)], ", ".join(f"`{c}` string" for c in names))
    got = bpe.encode(df, RANKS, public_tokenizers.PATTERN, names).collect()
    assert len(got) == 5 and all(list(r["ids"]) == library.encode_ordinary(r["text"]) and r["a b"] == r["text"].replace("text", "a b") for r in got)
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode(df.withColumn("ids", df["n"]), RANKS, public_tokenizers.PATTERN, ["ids"])


def test_shards_grow_with_the_partitions(spark):
    from tarn.llm.blocks import shards_of

    sizes = [shards_of(spark.range(1000, numPartitions=n)) for n in (1, 16, 256, 4096)]
    assert sizes == [128, 256, 512, 1024]


def test_decode_takes_the_place_of_columns_with_its_names(spark):
    df = spark.createDataFrame([(1, [72, 105], "mine"), (2, [], "mine"), (3, None, "mine"), (1, [72, 105], "mine")], "k long, ids array<int>, ids_sha256 string")
    made = {r.k: r for r in bpe.decode(df, RANKS, digests=True, keep_ids=True).collect()}
    assert made[1].ids_sha256 == hashlib.sha256(struct.pack("<2I", 72, 105)).hexdigest() and made[3].ids_sha256 is None
    assert made[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() and made[1].ids == [72, 105]
    assert len(bpe.decode(df, RANKS, digests=True).collect()) == 4
