"""Mixing sources to target weights: budgets handed down a tree, leaves read in seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut, quoted, unused, without

ADDED = ("n_tokens", "epoch", "take_tokens")
#: Seeded order is dealt into this many slices of each leaf, so that only one slice a leaf is put in order row by row.
SLICE_DIGITS = 4


def _path(levels: Sequence[str]) -> Column:
    """The name of a node: its names from the top, slashes and backslashes in them marked, joined by slashes."""
    names = [F.coalesce(quoted(x).cast("string"), F.lit("")) for x in levels]
    marked = [F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/")) for name in names]
    return F.concat_ws("/", *marked)


def _check_weights(weights: DataFrame) -> None:
    weight = F.col("weight").cast("double")
    odd = (weight < 0) | F.isnan(weight) | (weight == float("inf"))
    nodes = weights.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd"))
    faults = nodes.where("n > 1 OR odd").orderBy("level", "key").limit(1).collect()
    if faults:
        level, key, n, _ = faults[0]
        raise ValueError(f"{level} {key}: {'more than one weight' if n > 1 else 'a weight is a finite number of 0 or more'}")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, levels: Sequence[str], total: int, max_epochs: int = 1) -> DataFrame:
    """(levels..., tokens, budget): the tokens to take from each leaf of the tree ``levels`` spell out.

    ``leaves``: (levels..., tokens); rows of one leaf are added up. ``weights``: (level, key, weight), key being the name
    of a node: its path from the top joined by slashes, in which a slash or backslash of a name follows a backslash, and
    null is named by the empty text, as the empty name is. A node without a row, or with a null weight, weighs 1. A weight that is
    negative or not finite, and two rows of one node, are a ValueError. A leaf can give ``max_epochs`` times its tokens, but nothing if a
    node of its path weighs 0; a node can give what its leaves can.

    From the top down a node's budget is shared among its children by weight. A child that cannot fill its share gives
    all it has, and the shortage goes to its siblings by weight, again and again; only what no sibling can take is felt
    above, where the node itself was such a child. The fill level that ends this has a closed form: children in the
    order of capacity a weight, the first one that is not exhausted sets it. Shares are rounded down, so a node's
    children may get fewer tokens than it by less than their number. Windows run over nodes, not over documents.
    """
    _check_weights(weights)
    paths = [_path(levels[: k + 1]) for k in range(len(levels))]
    named = leaves.select("*", *[path.alias(f"path_{k + 1}") for k, path in enumerate(paths)])
    tree = named.groupBy(*[f"path_{k + 1}" for k in range(len(levels))]).agg(
        *[F.min(quoted(x)).alias(x) for x in levels], F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")
    )
    tree = tree.withColumn("path_0", F.lit(""))
    open_ = F.lit(True)
    for k, level in enumerate(levels):
        own = weights.where(F.col("level") == level).select(F.col("key").alias(f"path_{k + 1}"), F.col("weight").cast("double").alias(f"weight_{k}"))
        tree = tree.join(own, f"path_{k + 1}", "left").withColumn(f"weight_{k}", F.coalesce(f"weight_{k}", F.lit(1.0)))
        open_ &= F.col(f"weight_{k}") > 0
    tree = tree.withColumn("give", F.when(open_, F.col("tokens") * F.lit(max_epochs)).otherwise(0))
    whole = tree.agg(F.least(F.coalesce(F.sum("give"), F.lit(0)), F.lit(total).cast("long")).alias("budget"))
    budgets = whole.select(F.lit("").alias("parent"), "budget")
    for k in range(len(levels)):
        nodes = tree.groupBy(F.col(f"path_{k}").alias("parent"), F.col(f"path_{k + 1}").alias("node")).agg(
            F.sum("give").cast("double").alias("cap"), F.max(f"weight_{k}").alias("weight")
        )
        filled = nodes.join(budgets, "parent")
        order = Window.partitionBy("parent").orderBy(F.col("cap") / F.col("weight"), "node")
        every = Window.partitionBy("parent")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.where("weight > 0").withColumns(
            {
                "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            }
        )
        filled = filled.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
        not_full = F.col("level") * F.col("weight") <= F.col("cap")
        filled = filled.withColumn("fill", F.min(F.when(not_full, F.struct(F.col("cap") / F.col("weight"), "node", "level"))).over(every)["level"])
        share = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("fill") * F.col("weight"))))
        budgets = filled.select(F.col("node").alias("parent"), F.floor(share).cast("long").alias("budget"))
    found = tree.join(budgets, tree[f"path_{len(levels)}"] == budgets.parent, "left")
    return found.select(*[quoted(x) for x in levels], "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))


def mix(
    docs: DataFrame, weights: DataFrame, levels: Sequence[str], total: int | None = None, *, share: float | None = None,
    tokens: Column | None = None, id: str = "doc_id", text: str = "text", seed: int = 0, max_epochs: int = 1,
) -> DataFrame:
    """The rows of ``docs`` that fill each leaf's budget, with n_tokens, epoch and take_tokens.

    Budgets: see ``leaf_budgets``; the whole one is ``total`` tokens or ``share`` of the tokens there are. ``tokens``:
    the size of a document, by default a quarter of its bytes, rounded up; a null size is 0. Of each leaf documents are
    taken in a seeded order, the whole of an epoch before the next one is begun in an order of its own, until its budget
    is reached. The document that reaches it is given whole; ``take_tokens`` says how many of its tokens the budget
    covers, and their sum over a leaf is the budget exactly. A document of size 0 is taken if its turn comes before the
    budget is reached.

    The order within an epoch is that of md5(seed:epoch:id); repeated ids follow their size. Its first SLICE_DIGITS hex
    digits cut a leaf into slices, which are summed; only rows of the slice in which the budget ends are put in order
    one by one, so a leaf of a third of all rows is no group in one task; rows of one id share a slice, so an id that
    very many rows repeat is one group if the budget ends there. A null level and an empty one are one node; an empty table gives no rows. Columns named like an added one are replaced. Built-in functions only.
    """
    docs = without(docs, *ADDED)
    size, key, mark, part, need, epochs, limit, before = unused(
        docs, "size_", "key_", "mark_", "slice_", "need_", "epochs_", "limit_", "before_"
    )
    counted = F.ceil(F.octet_length(quoted(text).cast("string")) / 4) if tokens is None else tokens
    leaf = _path(levels)
    rows = docs.withColumns({size: F.coalesce(counted, F.lit(0)).cast("long"), key: leaf})
    leaves = cut(rows.groupBy(*[quoted(x) for x in levels]).agg(F.sum(size).alias("tokens")))
    if total is None:
        available = leaves.agg(F.sum("tokens")).first()[0] or 0
        total = int(available * (1.0 if share is None else share))
    budgets = leaf_budgets(leaves, weights, levels, total, max_epochs)
    # whole epochs of each leaf, and what the begun one still needs
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    budgets = budgets.select(leaf.alias(limit), full.alias(epochs), (F.col("budget") - full * F.col("tokens")).alias(need))
    budgets = cut(budgets)

    small = rows.select(key, size, quoted(id).alias(mark)).join(_sized(budgets), F.col(key) == F.col(limit))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epochs).cast("string"), F.coalesce(F.col(mark).cast("string"), F.lit(""))))
    small = small.select(key, size, digest.alias(mark), F.substring(digest, 1, SLICE_DIGITS).alias(part))
    sums = small.groupBy(key, part).agg(F.sum(size).alias("n"))
    running = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum("n").over(running), F.lit(0)).cast("long"))
    # the slice in which each leaf's budget ends, and what is still needed when it begins
    ends = sums.join(budgets, F.col(key) == F.col(limit)).where((F.col(before) < F.col(need)) & (F.col(need) <= F.col(before) + F.col("n")))
    ends = ends.groupBy(F.col(key).alias("end_key")).agg(F.min(F.struct(part, before)).alias("end"))
    plan = budgets.join(ends, F.col(limit) == F.col("end_key"), "left").select(
        limit, epochs, need, F.col("end")[part].alias("end_slice"), F.col("end")[before].alias("end_before")
    )
    names = dict(zip(("end_slice", "end_before"), unused(docs, "end_slice", "end_before")))
    plan = cut(plan.withColumnsRenamed(names))

    judged = rows.join(_sized(plan), F.col(key) == F.col(limit))
    own = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epochs).cast("string"), F.coalesce(quoted(id).cast("string"), F.lit(""))))
    judged = judged.withColumn(mark, own).withColumn(part, F.substring(mark, 1, SLICE_DIGITS))
    slice_, end, start = F.col(part), F.col(names["end_slice"]), F.col(names["end_before"])
    fields = [*docs.columns, size, epochs]
    # epochs taken whole, and the slices of the begun one before the last
    begun = F.when(F.col(need) > 0, F.coalesce(slice_ < end, F.lit(False))).otherwise(F.lit(False))
    copies = F.concat(
        F.when(F.col(epochs) > 0, F.sequence(F.lit(0).cast("long"), F.col(epochs) - 1)).otherwise(F.array().cast("array<bigint>")),
        F.when(begun, F.array(F.col(epochs))).otherwise(F.array().cast("array<bigint>")),
    )
    whole = judged.withColumn("epoch", F.explode(copies)).withColumn("take_tokens", F.col(size))
    # the last slice, row by row: places of its rows by id and size, then a join with the rows themselves
    last = judged.where((F.col(need) > 0) & (slice_ == end))
    order = Window.partitionBy(key).orderBy(mark, size).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn(before, start + F.coalesce(F.sum(size).over(order), F.lit(0)))
    last = last.where(F.col(before) < F.col(need)).withColumn("epoch", F.col(epochs))
    last = last.withColumn("take_tokens", F.least(F.col(size), F.col(need) - F.col(before)))
    out = [*[quoted(name) for name in docs.columns], F.col(size).alias("n_tokens"), F.col("epoch").cast("int"), F.col("take_tokens").cast("long")]
    return whole.select(*out).unionByName(last.select(*out))


#: Leaves whose plan is broadcast.
MOST_BROADCAST = 20_000


def _sized(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan
