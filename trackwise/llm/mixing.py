"""Mixing sources to target weights by hierarchical budgeting.

Leaves are domain / language / source. A token budget goes down the tree: each
node's budget is shared among its children by weight; a child that can't use its
share (tokens times the epochs allowed) is filled up and its shortage is shared
among its siblings, and only what a whole subtree can't take reaches the
siblings of its ancestors. In each leaf the budget becomes whole epochs plus a
prefix, by tokens, of the next epoch's seeded order.

All sums are integers. A running sum over a hot leaf is never one task: the order
key's first two pairs of hex digits make buckets whose sums are accumulated first.

Defined cases: null domain, language or source is a leaf value of its own; null
or blank text has no tokens and is taken with its leaf's whole epochs, or when
the prefix reaches its place; rows with one doc_id share a place in the order
and are taken together; weights that are missing count as 1, a weight of 0
takes nothing unless siblings run short of tokens; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

LEVELS = ("domain", "lang", "source")
DOMAINS = 4


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo ``DOMAINS``."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint") % DOMAINS, F.lit(0)).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent..., budget, cap, weight) -> with ``given``: water-filling of the parent's budget, in integers.

    Children are taken in the order of cap / weight; a child is full when its
    share of what is left, over the weight left, exceeds its cap.
    """
    by = Window.partitionBy(*parent)
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = by.orderBy("ratio", "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("ratio", ratio).withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    nodes = nodes.withColumn("weight_left", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    nodes = nodes.withColumn("left", F.greatest(F.col("budget") - F.col("cap_before"), F.lit(0)))
    # products of token counts and weights may need more than 64 bits
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    nodes = nodes.withColumn("full", F.expr(f"if(weight > 0, {wide('left')} * {wide('weight')} >= {wide('cap')} * {wide('weight_left')}, false)"))
    nodes = nodes.withColumn("n_full", F.sum(F.col("full").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    # the full ones come first; what they leave is shared by those behind them
    nodes = nodes.withColumn("is_full", F.col("n_full") == F.col("place"))
    nodes = nodes.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(by), F.lit(0)))
    nodes = nodes.withColumn("open_weight", F.coalesce(F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(by), F.lit(0)))
    # children of weight 0 take what is left, in order, when all others are full
    nodes = nodes.withColumn("open_before", F.coalesce(F.sum(F.when(~F.col("is_full"), F.col("cap"))).over(before), F.lit(0)))
    given = F.expr(
        f"case when is_full then cap when open_weight > 0 then {wide('budget - full_cap')} * {wide('weight')} div {wide('open_weight')} "
        "else greatest(0, least(cap, budget - full_cap - open_before)) end"
    )
    return nodes.withColumn("given", given)


def _null_safe(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; other's keys are dropped."""
    renamed = other.select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in other.columns if c not in keys])
    return rows.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*[f"_{c}" for c in keys])


def leaf_budgets(leaves: DataFrame, share_percent: int, weights: dict[str, dict[str, int]] | None = None, epochs: int = 2) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> with ``budget`` of each leaf. Weights: level -> name -> integer."""
    weights = weights or {}

    def weight(level: str) -> Column:
        known = weights.get(level) or {}
        out = F.lit(1)
        for name, w in known.items():
            out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
        return out.cast("long")

    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    top = caps.agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).select(F.expr(f"least(cap, tokens * {int(share_percent)} div 100)").alias("budget"))
    level: DataFrame = top
    for depth, name in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        children = caps.groupBy(*own).agg(F.sum("cap").alias("cap"))
        children = children.withColumn("weight", weight(name)).withColumn("child", F.col(name))
        if parent:
            children = _null_safe(children, level, parent).select(*own, "cap", "weight", "child", "budget")
        else:
            children = children.crossJoin(F.broadcast(level))  # one row
        level = _share(children, parent).select(*own, F.col("given").alias("budget"))
    return _null_safe(leaves, level, list(LEVELS)).select(*leaves.columns, "budget")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(text.cast("binary"))


def leaf_plan(rows: DataFrame, share_percent: int, weights: dict[str, dict[str, int]] | None, epochs: int, seed: int, scratch: Scratch) -> DataFrame:
    """rows (domain, lang, source, doc_id, n_tokens) -> leaves with budget, whole epochs and the last key of the prefix."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = scratch.write(leaves, "leaves")
    plan = leaf_budgets(leaves, share_percent, weights, epochs)
    plan = plan.withColumn("whole", F.expr("if(tokens > 0, budget div tokens, 0)").cast("long")).withColumn("rest", F.expr("budget - whole * tokens"))
    plan = scratch.write(plan.withColumn("leaf", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) for c in LEVELS]), 256)), "budgets")
    slim = plan.select(*LEVELS, "leaf", "rest", "whole")
    placed = _null_safe(rows, slim, list(LEVELS)).select("leaf", "rest", "n_tokens", order_key(seed, F.col("whole"), F.col("doc_id")).alias("key"))
    placed = placed.withColumn("b1", F.substring("key", 1, 2)).withColumn("b2", F.substring("key", 3, 2))
    fine = placed.groupBy("leaf", "b1", "b2").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    fine = scratch.write(fine, "fine")
    coarse = fine.groupBy("leaf", "b1").agg(F.sum("t").alias("t"))
    run = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("base1", F.coalesce(F.sum("t").over(run("leaf").orderBy("b1")), F.lit(0))).select("leaf", "b1", "base1")
    fine = fine.withColumn("base2", F.coalesce(F.sum("t").over(run("leaf", "b1").orderBy("b2")), F.lit(0)))
    fine = fine.join(coarse, ["leaf", "b1"]).withColumn("base", F.col("base1") + F.col("base2"))
    # the bucket in which the prefix ends is the only one whose rows need a running sum
    fine = scratch.write(fine.where("base <= rest").select("leaf", "b1", "b2", "base", "t", "rest"), "open")
    full = fine.where("base + t <= rest").groupBy("leaf").agg(F.max(F.concat("b1", "b2", F.lit("g"))).alias("cut"))
    edge = fine.where("base + t > rest").select("leaf", "b1", "b2", "base")
    inner = placed.join(edge, ["leaf", "b1", "b2"])
    reach = F.sum("n_tokens").over(Window.partitionBy("leaf", "b1", "b2").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    inner = inner.withColumn("reach", F.col("base") + reach).where("reach <= rest").groupBy("leaf").agg(F.max("key").alias("cut"))
    cuts = full.unionByName(inner).groupBy("leaf").agg(F.max("cut").alias("cut"))
    plan = scratch.write(plan.join(cuts, "leaf", "left"), "plan")
    scratch.drop("leaves", "budgets", "fine", "open")
    return plan


def mix_sources(docs: DataFrame, share_percent: int = 60, weights: dict[str, dict[str, int]] | None = None, epochs: int = 2, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, domain, lang, source, n_tokens, leaf_budget and copies (0: left out).

    The budget is ``share_percent`` of all tokens; a document is taken ``copies``
    times: once for each whole epoch of its leaf, and once more in the prefix.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("source")).alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), token_count(F.col("text").cast("string")).alias("n_tokens"))
    rows = scratch.write(rows, "rows")
    plan = leaf_plan(rows, share_percent, weights, epochs, seed, scratch)
    return apply_plan(rows, plan, seed)


def apply_plan(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    slim = plan.select(*LEVELS, F.col("budget").alias("leaf_budget"), "whole", "cut")
    extra = F.coalesce(order_key(seed, F.col("whole"), F.col("doc_id")) <= F.col("cut"), F.lit(False)).cast("long")
    return _null_safe(rows, slim, list(LEVELS)).select(*rows.columns, "leaf_budget", (F.col("whole") + extra).alias("copies"))
