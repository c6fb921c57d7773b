import hashlib
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from tarn.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(digests):
    """The root and every leaf's siblings as (side, digest), upwards."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, place in enumerate(at):
            other = place ^ 1
            if other < len(level):
                proofs[k].append(("L" if other < place else "R", level[other]))
            else:
                proofs[k].append(("A", ""))
            at[k] = place >> 1
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def plain(rows):
    def leaf(r, more=0):
        doc_id, text, lang, source, n = r
        return h(*map(field, (doc_id, source, lang, None if n is None else n + more, text)))

    first = lambda x: (x is not None, (x or "").encode() if isinstance(x, str) else x or 0)
    ordered = sorted(rows, key=lambda r: (first(r[2]), first(r[0]), leaf(r)))
    groups = [list(g) for _, g in groupby(ordered, key=lambda r: r[2])]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, proofs), more in zip(groups, trees, above, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            steps = proof + more
            now = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for side, d in steps:
                now = h(d, now) if side == "L" else h(now, d)
            out.append((r[0], leaf(r), subroot, root, h(*(d for _, d in steps)), now, now == root))
    return out


def found(df):
    key = lambda r: tuple(map(str, r))
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=key)


def rows():
    long = "x" * 300_000
    made = [(i, f"text {i} é中", ["en", "de", None, "zé", "Z"][i % 5], f"s{i % 3}", i) for i in range(60)]
    made += [(100, None, None, None, None), (None, "no id", "en", "s", 3), (None, "no id", "en", "s", 3), (None, None, None, None, None)]
    made += [(7, "same", "en", "s", 4), (7, "same", "en", "s", 4), (7, "other", "en", "s", 5), (101, "", "", "", 0), (102, long, "one", "s", len(long))]
    return made


def test_equals_a_plain_version(spark):
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA).repartition(5).withColumns({"place": F.lit(1), "proof": F.lit("p"), "tree": F.lit("t")})
    want = sorted(plain(given), key=lambda r: tuple(map(str, r)))
    assert found(merkle.audited(docs)) == want
    assert {r[6] for r in want} == {True, False}


def test_units_of_any_size_give_the_same_trees(spark):
    sizes = [1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 64, 65]
    of = {n: [hashlib.sha256(f"{n} {i}".encode()).digest() for i in range(n)] for n in sizes}
    leaves = spark.createDataFrame([(n, i, d) for n, ds in of.items() for i, d in enumerate(ds)], "lang long, doc_id long, leaf binary")
    made = merkle.manifest(leaves, "lang", ["doc_id"], "leaf", bits=2).collect()
    trees = {n: tree([d.hex() for d in ds]) for n, ds in of.items()}
    root, above = tree([trees[n][0] for n in sizes])
    sides = {-1: "L", 0: "A", 1: "R"}
    got = {(r.lang, r.place): [(sides[s.side], (s.digest or b"").hex()) for s in r.proof] for r in made}
    assert got == {(n, k): p + more for n, more in zip(sizes, above, strict=True) for k, p in enumerate(trees[n][1])}
    assert {(r.lang, r.subroot.hex(), r.root.hex()) for r in made} == {(n, trees[n][0], root) for n in sizes}


def test_any_column_names_and_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.audited(empty).collect() == []
    clash = spark.createDataFrame([("x", 1, b"\2" * 32, "mine")], "`tree.of` string, seq long, digest binary, root string")
    one = merkle.manifest(clash, "tree.of", ["seq"], "digest").collect()
    assert len(one) == 1 and one[0].root == b"\2" * 32 and one[0].subroot == b"\2" * 32


def test_a_group_with_most_rows_is_placed_in_ranges(spark):
    leaves = spark.range(5000).select(F.lit("hot").alias("lang"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    made = merkle.manifest(leaves, "lang", ["doc_id"], "leaf")
    assert made.where("place = doc_id").count() == 5000
    root, _ = tree([hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)])
    assert made.select(merkle.hexed(F.col("root"))).distinct().collect()[0][0] == root
