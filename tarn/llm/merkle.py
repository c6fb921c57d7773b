"""A Merkle manifest of a table: leaf digests, roots, proofs, and their check.

Rows are leaves of a tree per group, in a stated order; the trees' roots are the leaves of one top
tree. A node is the digest of its two children's digests one after the other, the last of an odd
level the digest of its only child. Nothing whole is gathered: a level of more than 2**bits nodes
is cut into units of so many neighbours, each the subtree of one node ``bits`` levels above.

Time-forward processing: every node has a label, and labels grow from children to parents. The
exchange by unit, whose rows the sort brings into label order on disk where memory ends, is the
external queue between units; inside a unit a heap delivers digests to parents. A sweep over all
units, round by round, ends at the root. A second one runs the labels backwards: a unit takes the
proof of its top from the unit above, and the heap delivers to each child its parent's proof with
the sibling before it.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import lean, sized, table
from tarn.llm.sql import crc32

#: Levels of a unit if not said otherwise: 1,024 nodes, some 100 kB with what is kept beside them.
BITS = 10

LEFT, ALONE, RIGHT = -1, 0, 1
#: A proof from the leaf up: where the sibling stands (ALONE: there is none) and its digest.
PROOF = "array<struct<side: tinyint, digest: binary>>"


def digest(*parts: Column) -> Column:
    """The SHA-256 of texts one after another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other; - if null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def _upward(digests: list[bytes], height: int) -> list[tuple[int, int, bytes]]:
    """(level, place, digest) of a unit's nodes in the order of their labels, the leaves first.

    A message (label of the receiver, side, digest) waits in the queue until its receiver is the
    smallest label; then all messages for it are there.
    """
    queue = [(0, k, 0, d) for k, d in enumerate(digests)]
    heapify(queue)
    nodes = []
    while queue:
        level, place, _, mine = heappop(queue)
        if level:
            text = mine.hex()
            while queue and queue[0][:2] == (level, place):
                text += heappop(queue)[3].hex()
            mine = hashlib.sha256(text.encode()).digest()
        nodes.append((level, place, mine))
        if level < height:
            heappush(queue, (level + 1, place >> 1, place & 1, mine))
    return nodes


def _downward(nodes: list[tuple[int, int, bytes]], above: tuple | None) -> list[tuple]:
    """The proof of every leaf as ((side, digest), rest), from that of the unit's top: ``nodes`` backwards."""
    known = {(level, place): d for level, place, d in nodes}
    level, place, _ = nodes[-1]
    queue = [(-level, -place, above)]
    leaves = []
    while queue:
        level, place, proof = heappop(queue)
        level, place = -level, -place
        if not level:
            leaves.append(proof)
            continue
        one, two = known[level - 1, 2 * place], known.get((level - 1, 2 * place + 1))
        heappush(queue, (1 - level, -2 * place, ((ALONE, None) if two is None else (RIGHT, two), proof)))
        if two is not None:
            heappush(queue, (1 - level, -2 * place - 1, ((LEFT, one), proof)))
    return leaves[::-1]  # the queue ran from the last leaf to the first


def _height(n: int, bits: int) -> int:
    return min(bits, (n - 1).bit_length())


def _climbed(units: DataFrame, bits: int) -> DataFrame:
    """(tree, unit, n, digest): the top node of every unit."""

    def run(batches):
        for batch in batches:
            tree, unit, n, members = (batch.column(k) for k in range(4))
            tops = [_upward(d, _height(count, bits))[-1][2] for d, count in zip(members.to_pylist(), n.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([tree, unit, n, pa.array(tops, pa.binary())], names=["tree", "unit", "n", "digest"])

    kind = units.schema["tree"].dataType.simpleString()
    return units.select("tree", "unit", "n", F.col("members.digest").alias("digests")).mapInArrow(lean(run), f"tree {kind}, unit long, n long, digest binary")


def _descended(units: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """tree, place, subroot, root, proof, and the fields of the members, for all nodes below."""
    met = units.withColumnRenamed("tree", "tree_").withColumnRenamed("unit", "unit_").join(above, F.col("tree_").eqNullSafe(F.col("tree")) & (F.col("unit_") == F.col("place")))
    members = units.schema["members"].dataType.elementType
    schema = T.StructType([above.schema["tree"], T.StructField("place", T.LongType()), above.schema["subroot"], above.schema["root"], T.StructField("proof", T._parse_datatype_string(PROOF)), *(f for f in members if f.name != "slot")])

    def run(batches):
        for batch in batches:
            trees, unit, n, proofs, subroots, roots, packed = (batch.column(k) for k in range(7))
            for i in range(batch.num_rows):
                rows = packed[i].values
                flat = None
                for side in reversed(proofs[i].as_py()):
                    flat = ((side["side"], side["digest"]), flat)
                made = _downward(_upward(rows.field("digest").to_pylist(), _height(n[i].as_py(), bits)), flat)
                sides, siblings, ends = [], [], [0]
                for proof in made:
                    while proof is not None:
                        (side, sibling), proof = proof
                        sides.append(side)
                        siblings.append(sibling)
                    ends.append(len(sides))
                steps = pa.StructArray.from_arrays([pa.array(sides, pa.int8()), pa.array(siblings, pa.binary())], names=["side", "digest"])
                take = pa.array([i] * len(rows), pa.int64())
                first = unit[i].as_py() << bits
                columns = [trees.take(take), pa.array(range(first, first + len(rows)), pa.int64()), subroots.take(take), roots.take(take), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]
                yield pa.RecordBatch.from_arrays([*columns, *(rows.field(f.name) for f in members if f.name != "slot")], names=schema.names)

    return met.select("tree", "unit_", "n", "proof", "subroot", "root", "members").mapInArrow(lean(run), schema)


def _units(nodes: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """(tree, unit, n, members) of nodes with a tree, a place in it and the tree's number of nodes; at most 2**bits members each, in order."""
    slot = F.col("place").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")
    members = F.array_sort(F.collect_list(F.struct(slot, "digest", *keep)))
    return table(nodes.groupBy("tree", F.shiftright("place", bits).alias("unit"), "n").agg(members.alias("members")))


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with their place in their tree and its number n of leaves, by ranges of (tree, order).

    Rows are numbered in their sorted range as it is written; a range's first place in a tree is
    what the ranges before hold of it. Rows equal in all of ``order`` and digest keep the order in
    which they were written first, and may lie in different ranges.
    """
    keys = ["tree", *order, "digest", "seq"]
    written = table(leaves.withColumn("seq", F.monotonically_increasing_id()))
    ranged = table(written.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("seq").withColumn("at", F.monotonically_increasing_id()))
    piece = F.shiftright("at", 33).alias("piece")
    pieces = ranged.groupBy(F.col("tree").alias("tree_"), piece).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    so_far, all_of = Window.partitionBy("tree_").orderBy("piece"), Window.partitionBy("tree_")
    starts = pieces.select("tree_", "piece", (F.sum("rows").over(so_far) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(all_of).alias("n"))
    met = ranged.join(sized(starts), F.col("tree").eqNullSafe(F.col("tree_")) & (piece == F.col("piece")))
    return met.withColumn("place", F.col("at") + F.col("shift")).drop("tree_", "piece", "shift", "at")


def _forest(leaves: DataFrame, order: list[str], keep: list[str], bits: int) -> list[DataFrame]:
    """The units of all rounds, from the leaves to where each tree is one node."""
    rounds = [_units(_placed(leaves, order), keep, bits)]
    left = rounds[0].agg(F.max("n")).first()[0] or 0
    while left > 1 << bits:
        left = -(-left >> bits)
        up = _climbed(rounds[-1], bits).select("tree", F.col("unit").alias("place"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), "digest")
        rounds.append(_units(up, [], bits))
    return rounds


def _proved(rounds: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    above = tops
    for units in reversed(rounds[1:]):
        above = _descended(units, above, bits).select("tree", "place", "subroot", "root", "proof")
    return _descended(rounds[0], above, bits)


def manifest(leaves: DataFrame, tree: str, order: list[str], digest: str, bits: int = BITS) -> DataFrame:
    """All columns of ``leaves`` and place (from 0 in its tree), subroot, root (binary) and proof of each row.

    A tree for each value of ``tree``, whose leaves are the rows' ``digest`` (binary) by ``order``
    ascending, nulls first; the trees' roots make the top tree in the order of ``tree``, null first.
    A null tree is a tree of its own. A tree of one leaf is that leaf, and so is a top tree of one.
    Rows with equal order stand in the order of their digests, equal rows next to each other, each
    with its own proof. An empty table gives an empty one. Columns may have any names; the new ones
    take the place of given ones of their names.
    """
    own = {c: f"keep{k}" for k, c in enumerate(leaves.columns)}
    rows = leaves.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), F.col(f"`{tree}`").alias("tree"), F.col(f"`{digest}`").alias("digest"))
    rounds = _forest(rows, [own[c] for c in order], list(own.values()), bits)
    subroots = table(_climbed(rounds[-1], bits).select(F.col("tree").alias("of"), "digest"))
    upper = _forest(subroots.withColumn("tree", F.lit(0)), ["of"], ["of"], bits)
    root = _climbed(upper[-1], bits).select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    tops = table(_proved(upper, root, bits)).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root", "proof")
    made = _proved(rounds, tops, bits)
    added = ("place", "subroot", "root", "proof")
    return made.select(*(F.col(n).alias(c) for c, n in own.items() if c not in added), *added)


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that ``leaf`` (hex) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.when(step.side == LEFT, F.concat(hexed(step.digest), node)).when(step.side == RIGHT, F.concat(node, hexed(step.digest))).otherwise(node), 256))


def siblings_digest(proof: Column) -> Column:
    """The SHA-256 (hex) of a proof's digests as hex text one after another."""
    known = F.filter(proof, lambda step: step.side != ALONE)
    return F.sha2(F.array_join(F.transform(known, lambda step: hexed(step.digest)), ""), 256)


#: Documents whose number of characters the check changes: those whose id's CRC-32 is divisible by it.
TAMPER = 7


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, checked against rows of which every seventh is changed.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex text. Null
    fields are digested as such, null ids come first and are never changed, nor is a null n_chars.
    Repeated rows are leaves of their own. No documents give no rows.
    """

    def leaf(characters: Column) -> Column:
        return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(characters), field(F.col("text")))

    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPER == 0
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(changed, leaf(F.col("n_chars") + 1)).alias("tampered"))
    made = manifest(rows, "lang", ["doc_id"], "leaf")
    found = made.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        siblings_digest(F.col("proof")).alias("proof_sha256"),
        folded(hexed(F.coalesce("tampered", "leaf")), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(characters: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", characters, "text"))) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """``name``: all nodes of the trees over ``leaves`` (tree, place, n, digest) with their level."""
    return f"""{name} AS (SELECT 0 AS level, tree, place, n, digest FROM {leaves}
UNION ALL SELECT level + 1, tree, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY level, tree, place // 2, n)"""


def _steps_sql(name: str, leaves: str, nodes: str) -> str:
    """``name``: for every leaf (tree, place) the list of its steps upwards: L, R or A and the sibling's digest."""
    return f"""{name} AS (SELECT l.tree, l.place, list(CASE WHEN s.digest IS NULL THEN 'A' WHEN s.place % 2 = 0 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY k.level) AS steps
FROM {leaves} l JOIN (SELECT DISTINCT level, tree, n FROM {nodes} WHERE n > 1) k ON k.tree IS NOT DISTINCT FROM l.tree
LEFT JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM l.tree AND s.level = k.level AND s.place = xor(l.place >> k.level, 1) GROUP BY 1, 2)"""


SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang AS tree, {_leaf_sql('n_chars')} AS digest, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % {TAMPER} = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql('a', 'l')},
t AS (SELECT tree AS lang, digest, 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM a WHERE n = 1),
{_tree_sql('b', 't')},
{_steps_sql('p', 'l', 'a')},
{_steps_sql('q', 't', 'b')},
m AS (SELECT doc_id, l.digest AS leaf, t.digest AS subroot, (SELECT digest FROM b WHERE n = 1) AS root, coalesce(tampered, l.digest) AS start, list_concat(coalesce(p.steps, []), coalesce(q.steps, [])) AS steps
FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.tree LEFT JOIN p ON p.tree IS NOT DISTINCT FROM l.tree AND p.place = l.place LEFT JOIN q ON q.place = t.place),
f AS (SELECT *, list_reduce(list_prepend(start, steps), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root FROM m)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> 'A'), lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""
