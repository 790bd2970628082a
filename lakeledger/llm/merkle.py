"""A manifest of a dataset: a hash tree over its rows, with a proof for every row, by a rollup of nested structs.

Rows are ranked in each tree, and the digits of a rank, in the base of the fan-out, say which node of which level a row
belongs to. The digit columns are grouped away one after another: each grouping hashes the nodes of a run and nests
their structs in that of the run. This goes on within bounded blocks of a tree; the blocks' nodes are the rows of the
next tier. On the way back a transform of the nested structs hands each node its path, and an explode makes rows of the
leaves: nothing is joined to find a proof.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import quoted, stored

#: Rows that are put in order in one partition.
RANGE = 250_000
STEP = "struct<before: string, after: string>"


def field(value: Column) -> Column:
    """A value as an input of a hash: ``-`` if null, else its length in UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` from 0 on in each ``tree`` and ``n``, the tree's number of rows.

    Rows are sorted by ranges of (tree, order); their place in the range and the rows of the ranges before give the rank.
    """
    parts = max(1, -(-rows.count() // RANGE))
    tied = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # equal rows may be many
    keys = ["tree", *order, "tie"]
    placed = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    ranges = ranges.select(
        "tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(by_tree).alias("n")
    )
    ranked = placed.withColumn("part", part).join(ranges, ["tree", "part"])
    return ranked.withColumn("rank", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "first", "before")


def _height(rows: int, fanout: int) -> int:
    """Levels above the leaves of a tree with so many, one at least."""
    levels = 1
    while fanout**levels < rows:
        levels += 1
    return levels


def _hashed(kids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(kids, lambda kid: kid["node"]), ""), 256)


def _by_digit(one: Column, other: Column) -> Column:
    return one["digit"] - other["digit"]


def _tier(rows: DataFrame, fanout: int, levels: int, base: int) -> DataFrame:
    """(tree, n, block, node, kids): blocks of ``levels`` levels above (tree, n, rank, node, ...), the rows' level being ``base``.

    A level of a single node is the end of its tree: the node is handed up as it is.
    """
    kept = [name for name in rows.columns if name not in ("tree", "n", "rank", "node")]
    digits = [F.pmod(F.floor(F.col("rank") / fanout**k), F.lit(fanout)).cast("int").alias(f"digit_{k}") for k in range(levels)]
    block = F.floor(F.col("rank") / fanout**levels).alias("block")
    rows = rows.select("tree", "n", block, *digits, "node", *kept).repartition("tree", "block")
    for k in range(levels):
        higher = [f"digit_{j}" for j in range(levels - 1, k, -1)]
        kid = F.struct(F.col(f"digit_{k}").alias("digit"), "node", *kept)
        rows = rows.groupBy("tree", "n", "block", *higher).agg(F.array_sort(F.collect_list(kid), _by_digit).alias("kids"))
        several = F.col("n") > F.lit(fanout ** (base + k))
        rows = rows.withColumn("node", F.when(several, _hashed(F.col("kids"))).otherwise(F.col("kids")[0]["node"]))
        kept = ["kids"]
    return rows


def _tiers(rows: DataFrame, fanout: int, levels: int, most: int) -> list[DataFrame]:
    """Tiers of blocks, until a block is a tree; ``most``: rows of the largest tree."""
    found, base = [], 0
    while True:
        found.append(stored(_tier(rows, fanout, levels, base)))
        base += levels
        if most <= fanout**base:
            return found
        rows = found[-1].select("tree", "n", F.col("block").alias("rank"), "node")


def _paths(tier: DataFrame, upper: DataFrame, fanout: int, levels: int, base: int) -> DataFrame:
    """(tree, rank, kid, path, subroot, root): the rows a tier was made of, each with its siblings from below up to the root.

    ``upper``: (tree, block, path, subroot, root) of the tier's blocks. Both have one row a block and meet by grouping.
    """
    given = tier.select("tree", "block", "n", "kids")
    both = given.unionByName(upper, allowMissingColumns=True).groupBy("tree", "block")
    whole = both.agg(*[F.first(name, ignorenulls=True).alias(name) for name in ("n", "kids", "path", "subroot", "root")])

    def unfold(kids: Column, path: Column, index: Column, level: int) -> Column:
        def placed(kid: Column) -> Column:
            def joined(chosen) -> Column:
                return F.array_join(F.transform(F.filter(kids, chosen), lambda x: x["node"]), "")

            step = F.struct(
                joined(lambda x: x["digit"] < kid["digit"]).alias("before"), joined(lambda x: x["digit"] > kid["digit"]).alias("after")
            )
            own = F.when(F.col("n") > F.lit(fanout ** (base + level)), F.concat(F.array(step), path)).otherwise(path)
            return F.struct(kid.alias("kid"), own.alias("path"), (index * fanout + kid["digit"]).alias("rank"))

        found = F.transform(kids, placed)
        if level == 0:
            return found
        return F.flatten(F.transform(found, lambda x: unfold(x["kid"]["kids"], x["path"], x["rank"], level - 1)))

    leaves = F.explode(unfold(F.col("kids"), F.col("path"), F.col("block"), levels - 1)).alias("leaf")
    return whole.select("tree", "subroot", "root", leaves).select("tree", "subroot", "root", "leaf.rank", "leaf.kid", "leaf.path")


def _proved(tiers: list[DataFrame], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    for k in range(len(tiers) - 1, 0, -1):
        upper = _paths(tiers[k], upper, fanout, levels, k * levels).withColumnRenamed("rank", "block").drop("kid")
    return _paths(tiers[0], upper, fanout, levels, 0)


def manifest(
    docs: DataFrame, fields: Sequence[str], id: str = "doc_id", tree: str = "lang", *, fanout: int = 2, block: int = 1024,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(id, carried columns, leaf, subroot, root, proof): one row for each of ``docs``.

    leaf: the SHA-256 (lowercase hex) of ``fields``, each as ``field`` writes it. Rows of one value of ``tree`` are
    ordered by ``id``; while several nodes remain, every ``fanout`` consecutive ones become the hash of their hex texts
    joined, the last run possibly of fewer. What remains is subroot. Subroots, ordered by ``tree`` (null first, by UTF-8
    bytes), give root in the same way. proof: from the leaf up to the root one struct a level with the hashes of the
    siblings ``before`` and ``after``, each joined; ``fold`` leads from a leaf and its proof to the root. ``carry``: columns of
    the result made of ``docs``.

    A null id comes first; rows of equal id are ordered by leaf, so equal rows have equal leaves but places, and proofs,
    of their own. An empty table has no root and gives no rows. No other column of ``docs`` reaches the result.

    ``block``: leaves whose nested structs are one row. Texts are read and hashed once and not shuffled; leaves are
    sorted by ranges, and grouped by block, whatever the number of trees or the share of one of them. The number of rows,
    of trees, and of rows of the largest tree are all that reaches the driver.
    """
    if fanout < 2 or block < fanout:
        raise ValueError("fanout: 2 at least; block: the fan-out at least")
    whole_block = _height(block + 1, fanout) - 1
    name = quoted(tree).cast("string")
    carried = F.struct(quoted(id).alias("id"), *[value.alias(f"c{k}") for k, value in enumerate((carry or {}).values())])
    leaves = stored(
        docs.select(
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"), quoted(id).alias("order"),
            row_hash([quoted(x) for x in fields]).alias("node"), carried.alias("item"),
        )
    )
    ranked = _ranked(leaves, ["order", "node"]).drop("order")
    most = ranked.agg(F.max("n")).first()[0] or 0
    levels = min(whole_block, _height(most, fanout))
    tiers = _tiers(ranked, fanout, levels, most)

    roots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("order"), "node", F.struct("tree").alias("item"))
    trees = _ranked(stored(roots), ["order"]).drop("order")
    most_trees = trees.agg(F.max("n")).first()[0] or 0
    levels_above = min(whole_block, _height(most_trees, fanout))
    above = _tiers(trees, fanout, levels_above, most_trees)
    empty = F.array().cast(f"array<{STEP}>")
    top = above[-1].select("tree", "block", empty.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    upper = _proved(above, top, fanout, levels_above).select(
        F.col("kid.item.tree").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("kid.node").alias("subroot"), "root"
    )
    found = _proved(tiers, upper, fanout, levels)
    return found.select(
        F.col("kid.item.id").alias(id), *[F.col(f"kid.item.c{k}").alias(x) for k, x in enumerate(carry or {})],
        F.col("kid.node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"),
    )


def tampered_rows(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and what it says of rows tampered with.

    Where 7 divides the CRC-32 of the decimal id, one is added to ``n_chars`` (null stays). (doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified): folded_root is what the row as it is now and its original proof lead to.
    """
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = row_hash([F.try_add("n_chars", F.lit(1)) if x == "n_chars" else quoted(x) for x in fields])
    now = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, tampered)
    proved = manifest(docs, fields, carry={"now": now})
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["before"], step["after"])), "")
    folded = proved.withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
