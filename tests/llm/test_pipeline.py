"""The pipeline: each stage against its operator and brute force, and the guard around the folder."""

import hashlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import corpus_pipeline
from tarn.llm import bpe, mixing, rules, toxicity
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_mixing import expected as mixture_of

SF = f"{DATA}/sf0.001"


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, seen = docs.columns, [docs.count()], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        sizes.append(len(after))
        seen.append((before, after))
        if k < 4:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("predicted = 1").collect()}
    assert set(seen[0][0]) - seen[0][1] == rejected
    passed = spark.read.parquet(str(tmp_path / "0"))
    assert seen[1][1] == {r["doc_id"] for r in rules.quality(passed, labels).where("predicted = 1").collect()}
    before, after = seen[2]
    want = {i for i, (_, root) in brute.near_duplicates(list(before.items()), 5).items() if root == i}
    assert after == want
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    domain = lambda source: "crawl" if source == "src0" else "reference" if len(source) == 4 else "community"
    rows = [(i, t, domain(table[i]["source"]), table[i]["lang"], table[i]["source"]) for i, t in seen[3][0].items()]
    assert {(i, 0) for i in seen[3][1]} == mixture_of(rows, mixing.WEIGHTS, corpus_pipeline.MIX_PERCENT, 1)[0]
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(seen[4][0][r["doc_id"]].encode()).hexdigest()
    run = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {r["doc_id"]: r["ids_sha256"] for r in docs.collect()}


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src0", 0), (-1, "", "en", "src0", 0)], docs.schema)
    for given in (docs.limit(0), rows):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, given, SF)
            assert made.count() <= 3 and (k == 4 or made.columns == docs.columns)


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for name in ("__spark_entry__.py", "tarn"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    (tmp_path / "tarn").mkdir()
    for part in (root / "tarn").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "tarn" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'traffic_yoy' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print('fine')"
    made = subprocess.run([sys.executable, "-P", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); " + code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert made.stdout.strip() == "fine", made.stderr


def test_the_last_stage_returns_the_encoded_corpus(spark):
    docs = spark.createDataFrame([(1, "some words, some more", "en", "src0", 21), (2, None, "en", "src0", 0)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = corpus_pipeline.encoded(spark, docs, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    table = {rank: token for token, rank in bpe._ranks(corpus_pipeline.RANKS).items()}
    for r in got.collect():
        assert len(r["ids"]) == r["n_tokens"]
        assert b"".join(table[i] for i in r["ids"]) == (b"some words, some more" if r["doc_id"] == 1 else b"")
