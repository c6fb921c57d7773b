"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import textkernel as tk
from tarn.llm.common import cut, lean, sized, table
from tarn.llm.components import components
from tarn.llm.units import dealt, roots, runs, together

#: SLOTS minima of BITS bits each; CHUNKS chunks of SLOTS // CHUNKS slots. Two signatures that
#: differ in at most MAX_ERRORS slots have, by pigeonhole, a chunk with at most ERRORS errors.
#: At a similarity of 0.8 a slot differs with probability 0.2, so a pair that just reaches it
#: differs in more than MAX_ERRORS of 60 slots about once in 3,000 times.
SLOTS, CHUNKS, BITS, ERRORS = 60, 12, 16, 1
MAX_ERRORS = CHUNKS * (ERRORS + 1) - 1
#: Sets and shingles of a block that are compared with another's at once, about, and rows of a
#: bucket in one unit. A block of longer texts has fewer; only a single text can pass the bound.
SET_BLOCK, SHINGLE_BLOCK, BUCKET_BLOCK = 256, 200_000, 1024
#: Bucket rows, and pairs of blocks, of one task, about.
TASK_ROWS, TASK_UNITS = 250_000, 64
#: Bits of a slot that go into the bit planes that bound the distance from below.
PLANES = 4

_draw = np.random.Generator(np.random.PCG64(4242))
_FACTORS = _draw.integers(0, 2**64, SLOTS, dtype=np.uint64) | np.uint64(1)
_KEY_SALT = _draw.integers(0, 2**64, (CHUNKS, SLOTS // CHUNKS), dtype=np.uint64)


def _minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS-bit minima (texts, SLOTS); texts with an empty set have zeros."""
    n = len(at) - 1
    out = np.zeros((n, SLOTS), dtype=np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        for k in range(SLOTS):
            out[full, k] = np.minimum.reduceat(sets * _FACTORS[k], at[:-1][full])
    return tk.mix(out) >> np.uint64(64 - BITS)


def _keys(minima: np.ndarray) -> np.ndarray:
    """Chunk keys (texts, SLOTS): every chunk with each one of its slots left out."""
    width = SLOTS // CHUNKS
    parts = minima.reshape(len(minima), CHUNKS, width)
    out = np.empty_like(parts)
    for skip in range(width):
        packed = np.zeros((len(minima), CHUNKS), dtype=np.uint64)
        for k in (k for k in range(width) if k != skip):
            packed = (packed << np.uint64(BITS)) | parts[:, :, k]
        out[:, :, skip] = tk.mix(packed ^ _KEY_SALT[:, skip])
    return out.reshape(len(minima), SLOTS)


def _planes(minima: np.ndarray) -> list[np.ndarray]:
    place = np.uint64(1) << np.arange(SLOTS, dtype=np.uint64)
    return [(((minima >> np.uint64(p)) & np.uint64(1)) * place).sum(axis=1, dtype=np.uint64).view(np.int64) for p in range(PLANES)]


def _sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    w = tk.split(buf, offsets)
    values, of = tk.shingles(tk.hash_spans(buf, w.starts, w.ends, folded=True), w.bounds, width)
    return tk.distinct(values, of, len(offsets) - 1)


def _sums(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The size of each set and two sums of hashes of its members."""
    return [np.diff(at), tk.per_text(sets, at).view(np.int64), tk.per_text(tk.mix(sets ^ np.uint64(0xA5A5)), at).view(np.int64)]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """id, digest (of the text), n_shingles, two sums that identify the shingle set, BITS-bit chunk keys and bit planes."""

    def made(buf, offsets):
        sets, at = _sets(buf, offsets, width)
        minima = _minima(sets, at)
        keys = _keys(minima)
        flat = np.arange(len(minima) + 1, dtype=np.int64) * SLOTS
        return [*_sums(sets, at), tk.lists(keys.reshape(-1), flat), *_planes(minima)]

    planes = "".join(f", p{p} long" for p in range(PLANES))
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return tk.over_texts(docs, ["id", "digest"], "text", f"n_shingles long, s1 long, s2 long, keys array<long>{planes}", made)


def _near_blocks(batches):
    """Pairs of different blocks of which two members of a bucket may be within the distance."""
    for unit in runs(batches, 3):
        block, side = unit.column("block").to_numpy(), unit.column("side").to_numpy()
        inside = unit.column("i")[0] == unit.column("j")[0]
        a, b = (np.arange(len(block)),) * 2 if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(a) or not len(b):
            continue
        differ = np.zeros((len(a), len(b)), dtype=np.uint64)
        for p in range(PLANES):
            plane = unit.column(f"p{p}").to_numpy().view(np.uint64)
            differ |= plane[a][:, None] ^ plane[b][None, :]
        x, y = np.nonzero((np.bitwise_count(differ) <= MAX_ERRORS) & (block[a][:, None] != block[b][None, :]))
        pairs = np.unique(np.stack([np.minimum(block[a[x]], block[b[y]]), np.maximum(block[a[x]], block[b[y]])], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of 0-1 matrices."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)

    def places(flat, sets):
        at = np.searchsorted(both, flat)
        held = both[np.minimum(at, len(both) - 1)] == flat
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    if len(both):
        (at_a, of_a), (at_b, of_b) = places(flat_a, a), places(flat_b, b)
        for low in range(0, len(both), 4096):
            parts = []
            for at, of, n in ((at_a, of_a, len(a)), (at_b, of_b, len(b))):
                one, two = np.searchsorted(at, [low, low + 4096])
                m = np.zeros((n, min(4096, len(both) - low)), dtype=np.float32)
                m[of[one:two], at[one:two] - low] = 1
                parts.append(m)
            out += parts[0] @ parts[1].T
    return out


def _linked(percent: int):
    def run(batches):
        for unit in runs(batches, 2):
            ids, side = unit.column("rep").to_numpy(), unit.column("side").to_numpy()
            held = unit.column("shingles").combine_chunks()
            at, values = held.offsets.to_numpy(), held.values.to_numpy()
            sets = [values[at[k] : at[k + 1]] for k in range(len(ids))]
            inside = unit.column("a")[0] == unit.column("b")[0]
            a, b = (np.arange(len(ids)),) * 2 if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if len(ids) < 2 or not len(a) or not len(b):
                continue
            size = np.array([len(s) for s in sets], dtype=np.float64)
            common = _common([sets[k] for k in a], [sets[k] for k in b]).astype(np.float64)
            linked = np.zeros((len(ids), len(ids)), dtype=bool)
            linked[np.ix_(a, b)] = 100 * common >= percent * (size[a][:, None] + size[b][None, :] - common)
            root = roots(ids, linked | linked.T)
            moved = np.flatnonzero(root != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(root[moved])], names=["a", "b"])

    return run


#: What identifies a shingle set: its size and two sums of 64-bit hashes of its members.
SAME = ["n_shingles", "s1", "s2"]


def _numbered(sets: DataFrame, filled: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """``sets`` with rep, a number of its own, the links (a, b) between sets that share an id, and whether ids repeat.

    The number is the set's smallest id. Where ids have several sets, only one of those with the
    same smallest id keeps it; others get numbers above all ids, and the links lead back.
    """
    spread = [f(c).alias(f"{n}{k}") for k, c in enumerate(SAME) for n, f in (("low", F.min), ("high", F.max))]
    several = " or ".join(f"low{k} < high{k}" for k in range(len(SAME)))
    again = cut(filled.groupBy("id").agg(F.count("*").alias("n"), *spread).where("n > 1").select("id", F.expr(several).alias("several")))
    repeated, twins = not again.isEmpty(), again.where("several").select("id")
    if twins.isEmpty():
        return sets.withColumn("rep", F.col("first")), None, repeated
    top = filled.agg(F.max("id")).first()[0]
    if top > 2**63 - 2**50:
        raise ValueError("an id that has several texts needs numbers above all ids, and there are none")
    place = F.row_number().over(Window.partitionBy("first").orderBy(*SAME))
    numbered = table(sets.withColumn("place", place).withColumn("rep", F.when(F.col("place") == 1, F.col("first")).otherwise(F.lit(top + 1) + F.monotonically_increasing_id())).drop("place"))
    held = cut(filled.join(sized(twins), "id").select("id", *SAME).distinct().join(numbered.select("rep", *SAME), SAME).select("id", "rep"))
    return numbered, held.join(held.groupBy("id").agg(F.min("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b"), repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id and kept.

    Texts are lower-cased (A-Z) and split into words; a text's set has its distinct runs of
    ``width`` words, a shorter text its whole word sequence. Texts are linked where
    100 * |intersection| >= ``percent`` * |union|; component_id is the smallest id that links reach.

    Sets of one size and equal 64-bit sums (SAME) are one representative, so copies cost one row
    each; copies are told by these sums, all other links by the full sets. Representatives meet in
    buckets of equal chunk keys: the multi-index join, which holds every pair whose signatures
    differ in at most MAX_ERRORS slots. Members of related buckets are dealt to blocks of about
    SET_BLOCK sets or SHINGLE_BLOCK shingles; two blocks are compared if a bucket holds a pair of
    their members whose bit planes allow the distance. Comparing blocks takes the exact
    intersections of all their full shingle sets, as products of 0-1 matrices, and returns a
    spanning forest of the links: no group of near copies makes a row per pair, and no pair within
    the distance is left out.

    Null and word-less texts have no shingles and stand alone. Rows with a null id have a null
    component and are kept; rows that repeat an id are one document, which has the links of all
    its texts. Very long texts count with all their shingles; a block of one such text may hold more
    than SHINGLE_BLOCK. An empty table gives an empty one. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = table(signatures(docs, "id", "text", width))
    planes = [f"p{p}" for p in range(PLANES)]
    filled = sigs.where("n_shingles > 0 and id is not null")
    sets = table(filled.groupBy(SAME).agg(F.min(F.struct("id", "digest")).alias("text"), F.min_by(F.struct("keys", *planes), "id").alias("sign")).withColumn("first", F.col("text.id")))
    sets, twins, repeated = _numbered(sets, filled)
    keyed = sets.select("rep", F.explode("sign.keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("n")).where("hub < last")
    buckets = cut(keyed.join(hubs.select("key", "hub", "n"), "key"))

    labels = buckets.groupBy("rep").agg(F.min("hub").alias("label")).join(sets.select("rep", "n_shingles"), "rep")
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.greatest(F.col("members") / SET_BLOCK, F.col("shingles") / SHINGLE_BLOCK)))
    placed = cut(labels.join(sizes, "label").select("rep", F.xxhash64("label", part).alias("block")))

    members = buckets.join(placed, "rep")
    mixed = members.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("key")
    shown = sets.select("rep", *(f"sign.{p}" for p in planes))
    units = dealt(members.join(mixed, "key", "left_semi").join(shown, "rep").select("key", "n", "rep", "block", *planes), ["key"], "rep", "n", BUCKET_BLOCK)
    rows = buckets.agg(F.sum(F.ceil(F.col("n") / BUCKET_BLOCK))).first()[0] or 0
    near = together(units.select("key", "i", "j", "side", "block", *planes), ["key", "i", "j"], rows // TASK_ROWS).mapInArrow(lean(_near_blocks), "a long, b long")
    pairs = cut(near.unionByName(placed.select(F.col("block").alias("a"), F.col("block").alias("b"))).distinct())

    def made(buf, offsets):
        full, at = _sets(buf, offsets, width)
        return [tk.lists(full, at)]

    # one text for each representative, chosen by its digest before it becomes shingles
    chosen = sized(cut(placed.join(sets.select("rep", "text.id", "text.digest"), "rep")))
    texts = docs.withColumn("digest", F.xxhash64("text")).join(chosen.select("id", "digest"), ["id", "digest"], "left_semi")
    if repeated:
        texts = texts.dropDuplicates(["id", "digest"])
    full = tk.over_texts(texts, ["id", "digest"], "text", "shingles array<long>", made)
    full = full.join(chosen, ["id", "digest"]).select("rep", "block", "shingles")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(pairs.where("a < b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block")))
    links = together(sides.join(full, "block").select("a", "b", "side", "rep", "shingles"), ["a", "b"], pairs.count() // TASK_UNITS).mapInArrow(lean(_linked(percent)), "a long, b long")
    whole = components(links if twins is None else links.unionByName(twins))

    classes = sets.select("rep", *SAME).join(whole.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*SAME, F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", *SAME).join(classes, SAME, "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document represents its group.

    Rows that repeat an id stay together: they are the same document. Rows with null ids and
    without words stay; an empty table gives an empty one. Columns may have any names.
    """
    dropped = cut(near_duplicates(docs, id_col, text_col, width, percent).where("not kept").select(id_col).distinct())
    return docs.join(sized(dropped), id_col, "left_anti").select(*(f"`{c}`" for c in docs.columns))


#: DuckDB SQL for two words and 80 percent: pairs that share one of their rarest shingles, checked in full.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM g),
f AS (SELECT h, count(*) AS df FROM u GROUP BY h),
o AS (SELECT u.doc_id, n, u.h, row_number() OVER (PARTITION BY u.doc_id ORDER BY df, u.h) AS k FROM u JOIN f ON f.h = u.h),
q AS (SELECT doc_id, n, h FROM o WHERE k <= n - (4 * n + 4) // 5 + 1),
m AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM q a JOIN q b ON a.h = b.h AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
i AS (SELECT x, y, count(*) AS c, min(a.n) AS na, min(b.n) AS nb FROM m JOIN u a ON a.doc_id = x JOIN u b ON b.doc_id = y AND b.h = a.h GROUP BY x, y),
p AS (SELECT x, y FROM i WHERE 100 * c >= 80 * (na + nb - c)),
s AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x AS id, x AS top FROM s UNION SELECT s.y, r.top FROM r JOIN s ON s.x = r.id),
c AS (SELECT id, min(top) AS top FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(top, doc_id) AS component_id, coalesce(coalesce(top, doc_id) = doc_id, true) AS kept FROM g LEFT JOIN c ON c.id = doc_id
"""
