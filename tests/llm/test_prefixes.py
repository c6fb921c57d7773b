import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tarn.llm import prefixes
from tarn.llm.entries import PIECES, QUERIES
from tests.conftest import DATA

PARTS = list("abcdetioxns     ") + ["é", "中", "😀", "▁", "<s>", "</s>", "<0x41>", "\n", "the ", "tion", "  ", "ing", " Ü", "\t", "0"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_every_prefix_of_mixed_texts(model):
    vocabulary, draw = prefixes.vocabulary(PIECES), random.Random(7)
    for _ in range(400):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(1, 40)))
        counts = vocabulary.prefixes([text])[0].cumsum(dtype=int).tolist()
        assert counts == [len(model.encode(text[:k])) for k in range(1, len(text) + 1)], text


def test_documents_count_as_the_library_does(spark, model):
    texts = dict(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect())
    made = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, f"{DATA}/sf0.001").collect()}
    assert made.keys() == texts.keys()
    for i, text in texts.items():
        r = made[i]
        assert (r.n_bytes, r.n_chars, r.n_tokens, r.over_limit) == (len(text.encode()), len(text), len(model.encode(text)), len(model.encode(text)) > 4096)
        assert r.chars_in_limit == len(text) or len(model.encode(text[: r.chars_in_limit])) <= 4096 < len(model.encode(text[: r.chars_in_limit + 1]))
    assert any(r.over_limit for r in made.values())


def test_nulls_empty_long_and_repeated_texts(spark, model):
    long = " " * 5000 + "ab" * 40_000 + " 中é" * 5000
    rows = [(1, None), (2, ""), (3, " "), (4, long), (4, long), (None, "a b"), (5, "<s></s>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "prefixes": F.lit(1)})
    made = prefixes.token_counts(docs, PIECES).collect()
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in made), key=order) == sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows), key=order)
    assert prefixes.token_counts(docs.limit(0), PIECES).collect() == []
    with pytest.raises(ValueError, match="must not be named"):
        prefixes.counted(docs, PIECES, ["n_tokens"])


def test_truncation_and_budgets_without_encoding_again(spark, model):
    texts = ["the tokens of this text", "a", "", "international  spaces and unknown 😀 characters", None]
    docs = spark.createDataFrame([(i, t, k) for i, t in enumerate(texts) for k in (None, -1, 0, 1, 2, 3, 5, 50)], "`doc.id` long, text string, k long")
    table = prefixes.counted(docs, PIECES, ["doc.id", "k"])
    for r in prefixes.truncated(table, F.col("k")).collect():
        text = texts[r["doc.id"]] or ""
        fits = [n for n in range(len(text) + 1) if len(model.encode(text[:n])) <= max(r.k or 0, 0)]
        assert r.chars_in_limit == (None if r.k is None else max(fits))
    for r in prefixes.tokens_before(table, F.col("k")).collect():
        text = texts[r["doc.id"]] or ""
        assert r.tokens_before == (None if r.k is None else len(model.encode(text[: max(r.k, 0)])))


def test_other_models_are_refused():
    with pytest.raises(Exception):  # noqa: B017 the library's own error
        prefixes.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
