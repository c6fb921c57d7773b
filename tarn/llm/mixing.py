"""Mixing sources to target weights by hierarchical token budgets, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, table

TOKEN = "[^\\\\x20\\\\x09-\\\\x0D]+"
#: A leaf table of up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_LEAVES = 20_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with ``right``'s other columns; null keys are equal."""
    renamed = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)) if keys else F.lit(True)
    return left.join(renamed, on, "left").drop(*(f"__{k}" for k in keys))


def _weight(values: Mapping[str, int], column: str) -> Column:
    """The node's weight in its level's table; 1 where it is not listed."""
    if any(int(w) < 0 for w in values.values()):
        raise ValueError(f"a weight of {column} is below 0")
    out = F.lit(1).cast("long")
    for value, weight in values.items():
        out = F.when(F.col(column) == value, F.lit(int(weight)).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """``nodes`` with alloc: the parent's ``budget`` dealt to its children by ``weight``.

    A child gets its weighted share but no more than ``capacity``; what a full child leaves goes
    to its siblings in proportion to their weights, again and again, which is the level at which
    the siblings not full all have the same allotment per weight. Sorted by capacity per weight,
    the full ones come first, so window sums find that level at once. The last tokens are dealt
    by name, so children add up to their parent's budget or their capacity. A child of weight 0 is
    full from the start and gets nothing. Weights and capacities are integers whose product fits
    63 bits.
    """
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
    whole = Window.partitionBy(*parents)
    by_fill = whole.orderBy(F.coalesce(F.try_divide("capacity", "weight"), F.lit(-1.0)), name)
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(earlier), F.lit(0))).withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    filled = filled.withColumn("full", F.col("capacity") * F.col("open") <= (F.col("budget") - F.col("used")) * F.col("weight"))
    filled = filled.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)))
    rest = F.when(~F.col("full"), F.col("weight")).otherwise(0)
    filled = filled.withColumn("rest", F.sum(rest).over(whole)).withColumn("upto", F.sum(rest).over(whole.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    filled = filled.withColumn("alloc", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("left * upto div rest - left * (upto - weight) div rest")))
    return filled.drop("used", "open", "full", "left", "rest", "upto")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels and tokens) with alloc, their tokens of the mixture.

    The budget is ``percent`` of all tokens. It is dealt level by level from the root; a node's
    capacity is what its leaves hold in ``max_epochs`` epochs. So a shortage is met by siblings
    first, and only what all of them cannot hold reaches the parent's siblings. A leaf below a
    node of weight 0 holds nothing.
    """
    used = reduce(lambda a, b: a & b, (_weight(weights.get(level, {}), level) > 0 for level in levels))
    held = leaves.withColumn("capacity", F.when(used, F.col("tokens") * max_epochs).otherwise(0))
    total = held.agg(F.sum("tokens")).first()[0] or 0
    above, parents = None, []
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = held.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("budget", F.lit(total * int(percent) // 100).cast("long")) if above is None else _same(nodes, above, parents)
        nodes = nodes.withColumn("budget", F.least("budget", F.sum("capacity").over(Window.partitionBy(*parents))))
        nodes = share_out(nodes.withColumn("weight", _weight(weights.get(level, {}), level)), parents, level)
        above, parents = nodes.select(*path, F.col("alloc").alias("budget")), path
    return nodes.select(*levels, "tokens", "alloc")


def _order(seed: int, epoch: Column, id_col: str) -> Column:
    """A document's place in an epoch: 32 hex digits that depend on the seed, the epoch and the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def plan(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, leaves): ids with levels and n_tokens; leaves with tokens, alloc, epochs and cut.

    A leaf takes ``epochs`` whole epochs and, of the next one, the documents whose order is not
    above ``cut``: the longest prefix whose tokens do not exceed what is left. To find the cut no
    leaf is sorted as a whole: tokens are summed by the first digits of the order, twice, and
    only the documents of one of 4096 parts are put in order.
    """
    small = docs.select(F.col(id_col).alias("id"), *(c.cast("string").alias(n) for n, c in levels.items()), F.coalesce(F.expr(f"regexp_count(cast(`{text_col}` as string), '{TOKEN}')"), F.lit(0)).cast("long").alias("n_tokens"))
    small, names = table(small), list(levels)
    leaves = budgets(cut(small.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))), names, weights, percent, max_epochs)
    leaves = cut(leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).cast("int")).withColumn("over", F.col("alloc") - F.col("epochs") * F.col("tokens")))
    placed = _joined(small, leaves.where("over > 0").select(*names, "epochs", "over"), names, "inner").withColumn("h", _order(seed, F.col("epochs"), "id"))
    placed = placed.withColumn("d1", F.substring("h", 1, 2)).withColumn("d2", F.substring("h", 3, 1))
    parts = cut(placed.groupBy(*names, "over", "d1", "d2").agg(F.sum("n_tokens").alias("n")))
    firsts = parts.groupBy(*names, "over", "d1").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy("d1")))
    first = firsts.where(F.col("upto") > F.col("over")).groupBy(*names).agg(F.min(F.struct("d1", "upto", "n")).alias("x")).select(*names, F.col("x.d1").alias("c1"), (F.col("x.upto") - F.col("x.n")).alias("used"))
    seconds = _same(parts, first, names).where("d1 = c1").withColumn("upto", F.col("used") + F.sum("n").over(Window.partitionBy(*names).orderBy("d2")))
    second = seconds.where(F.col("upto") > F.col("over")).groupBy(*names).agg(F.min(F.struct("d2", "upto", "n", "c1")).alias("x")).select(*names, F.concat("x.c1", "x.d2").alias("part"), (F.col("x.upto") - F.col("x.n")).alias("used"))
    inside = _joined(placed, second, names, "inner").where(F.concat("d1", "d2") == F.col("part")).groupBy(*names, "over", "used", "h").agg(F.sum("n_tokens").alias("n"))
    inside = inside.withColumn("upto", F.col("used") + F.sum("n").over(Window.partitionBy(*names).orderBy("h")))
    last = inside.where(F.col("upto") <= F.col("over")).groupBy(*names).agg(F.max("h").alias("last"))
    whole = _same(_same(leaves, second, names), last, names)
    # a leaf without a part that overflows takes all of them; in its part, what comes before the first document is taken
    return small, cut(whole.select(*names, "tokens", "alloc", "epochs", F.when(F.col("over") > 0, F.coalesce("last", "part")).alias("cut")))


def _joined(rows: DataFrame, leaves: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    right = leaves.select(*(F.col(n).alias(f"__{n}") for n in names), *(c for c in leaves.columns if c not in names))
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names))
    return rows.join(right, on, how).drop(*(f"__{n}" for n in names))


def _sized(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _copies(seed: int, id_col: str) -> Column:
    partial = F.coalesce(_order(seed, F.col("epochs"), id_col) <= F.col("cut"), F.lit(False)).cast("int")
    return F.col("epochs") + partial


def mixture(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and epoch of the mixture: id, epoch, the levels and n_tokens.

    Tokens are words of the whole text. Null texts have none; null levels are values of their
    own; null ids are ordered as empty ones. Rows that repeat an id stand or fall together. A
    document without tokens is taken if its place is before the cut or a whole epoch is.
    """
    small, leaves = plan(docs, levels, weights, percent, max_epochs, seed, id_col, text_col)
    names = list(levels)
    taken = _joined(small, _sized(leaves.select(*names, "epochs", "cut")), names, "inner").withColumn("copies", _copies(seed, "id")).where("copies > 0")
    return taken.select(F.col("id").alias(id_col), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), *names, "n_tokens")


def mixed(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mixture with all their columns, once for each epoch that takes them.

    Null and empty texts have no tokens: such a document is taken as ``mixture`` says. Very long
    texts count whole; a document that passes what is left of its leaf ends the prefix before it.
    Null ids are ordered as empty ones; rows that repeat an id stand or fall together. No
    documents give no rows. Columns of ``docs`` may have any names, those of ``levels`` too.
    """
    _, leaves = plan(docs, levels, weights, percent, max_epochs, seed, id_col, text_col)
    mark = "mix_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    names = list(levels)
    right = leaves.select(*(F.col(f"`{n}`").alias(f"{mark}{k}") for k, n in enumerate(names)), F.col("epochs").alias(f"{mark}epochs"), F.col("cut").alias(f"{mark}cut"))
    on = reduce(lambda a, b: a & b, (levels[n].cast("string").eqNullSafe(F.col(f"{mark}{k}")) for k, n in enumerate(names)))
    copies = F.col(f"{mark}epochs") + F.coalesce(_order(seed, F.col(f"{mark}epochs"), id_col) <= F.col(f"{mark}cut"), F.lit(False)).cast("int")
    taken = docs.join(_sized(right), on, "inner").withColumn(f"{mark}copies", copies).where(F.col(f"{mark}copies") > 0)
    return taken.withColumn(f"{mark}epoch", F.explode(F.sequence(F.lit(1), F.col(f"{mark}copies")))).select(*(f"`{c}`" for c in docs.columns))


#: The mixture of the test tables: domains by source, and the weights of the nodes of each level.
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'reference' ELSE 'community' END"
WEIGHTS = {"domain": {"crawl": 3, "reference": 4, "community": 3}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src3": 4, "src12": 2}}


def document_levels() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def oracle(weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int, seed: int = 7) -> str:
    """DuckDB SQL for ``mixture`` of documents with ``document_levels``."""
    names = ["domain", "lang", "source"]

    def weight(level):
        return "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in weights.get(level, {}).items()) + " ELSE 1 END"

    parts = [
        "d AS (SELECT doc_id, " + DOMAIN + r" AS domain, lang, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents)",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {max_epochs} AS capacity FROM d GROUP BY ALL)",
    ]
    for k, level in enumerate(names):
        path, up = ", ".join(names[: k + 1]), names[:k]
        by = f"PARTITION BY {', '.join(up)} " if up else ""
        budget = f"(SELECT b.alloc FROM a{k - 1} b WHERE {' AND '.join(f'b.{n} IS NOT DISTINCT FROM n.{n}' for n in up)})" if up else f"(SELECT CAST(sum(tokens) AS BIGINT) * {percent} // 100 FROM leaf)"
        parts += [
            f"n{k} AS (SELECT {path}, CAST(sum(capacity) AS BIGINT) AS capacity, {weight(level)} AS weight FROM leaf GROUP BY {path})",
            f"b{k} AS (SELECT n.*, {budget} AS parent FROM n{k} n)",
            f"c{k} AS (SELECT *, least(parent, sum(capacity) OVER ({by})) AS budget, coalesce(sum(capacity) OVER w, 0) AS used, sum(weight) OVER ({by}) - coalesce(sum(weight) OVER w, 0) AS opened FROM b{k} WINDOW w AS ({by}ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"e{k} AS (SELECT *, capacity * opened <= (budget - used) * weight AS filled FROM c{k})",
            f"f{k} AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({by}), 0) AS remain, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS rest, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS upto FROM e{k})",
            f"a{k} AS (SELECT {path}, CAST(CASE WHEN filled THEN capacity ELSE (remain * upto) // rest - (remain * (upto - weight)) // rest END AS BIGINT) AS alloc FROM f{k})",
        ]
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
, g AS (SELECT l.domain, l.lang, l.source, alloc, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs, alloc - CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END * tokens AS over_
  FROM leaf l JOIN a2 a ON l.domain IS NOT DISTINCT FROM a.domain AND l.lang IS NOT DISTINCT FROM a.lang AND l.source IS NOT DISTINCT FROM a.source)
, h AS (SELECT d.*, epochs, over_, md5('{seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN g ON d.domain IS NOT DISTINCT FROM g.domain AND d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source)
, p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM h)
, q AS (SELECT *, epochs + CASE WHEN over_ > 0 AND upto <= over_ THEN 1 ELSE 0 END AS copies FROM p)
SELECT doc_id, CAST(unnest(range(copies)) AS INTEGER) AS epoch, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens FROM q WHERE copies > 0
"""
    )
