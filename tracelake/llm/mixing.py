"""Mixing sources to target weights: hierarchical token budgets over domain, language and source.

The budget goes down the tree: each node's share is split among its children by weight; a child that has fewer tokens
(times the epochs allowed) than its share takes all it has and the rest goes to its siblings by weight.  A node never
gets more than its leaves hold, so a shortage is met by siblings first and passes to the ancestors' siblings only when
they are used up.  Each leaf orders its documents by a seeded hash per epoch: whole epochs first, then the longest
prefix that fits the tokens left.

The order within a leaf is found without gathering it: documents fall into hash ranges, token sums of the ranges
are added up in order, and only within a range are documents sorted.

Defined results: null domain, language or source counts as "unknown"; null text has no tokens; documents without
tokens come along where their place in the order is reached; rows that repeat an id take neighbouring places, ties are
broken by token count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.sources.shared import cut

#: Hash ranges of a leaf.
RANGES = 4096
TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


class Plan(NamedTuple):
    """weights: level -> value -> weight; values that aren't listed weigh 1.  fraction: of all tokens, the budget."""

    weights: dict[str, dict[str, int]]
    fraction: float
    epochs: int = 1
    seed: int = 17


# The production plan. Domains stand for groups of sources.
PLAN = Plan({"domain": {"hub": 3, "web": 5, "books": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}, 0.6, 2)
STAGE_PLAN = PLAN._replace(fraction=0.8, epochs=1)


def domain_of(source: Column) -> Column:
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(n == 0, "hub").when(n < 12, "web").when(n.isNotNull(), "books").otherwise("unknown")


def _weight(level: str, plan: Plan) -> Column:
    known = plan.weights.get(level, {})
    out = F.lit(1)
    for value, w in known.items():
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of each row."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    return docs.select(
        F.col("doc_id"), F.coalesce(domain_of(F.col("source")), F.lit("unknown")).alias("domain"), known("lang"), known("source"),
        F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves (levels, supply) with the column budget, whole tokens, for each leaf."""
    node = leaves.withColumn("cap", (F.col("supply") * plan.epochs).cast("double"))
    total = node.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("s"), F.coalesce(F.sum("cap"), F.lit(0.0)).alias("c"))
    root = total.select(F.least(F.floor(F.col("s") * plan.fraction).cast("double"), F.col("c")).alias("budget")).first().budget
    parent, above = None, []
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        children = node.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, plan).cast("double"))
        children = children.join(parent, above) if above else children.withColumn("budget", F.lit(root))
        order = (Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))).orderBy(F.col("cap") / F.col("w"), level)
        filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        open_ = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        # siblings by how soon they run out: those before hold nothing back, those from here on share what is left
        rate = (F.col("budget") - filled) / open_
        children = children.withColumn("rate", rate).withColumn("short", F.col("cap") <= F.col("w") * F.col("rate"))
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level_rate = F.max(F.when(~F.col("short"), F.col("rate"))).over(whole)
        children = children.withColumn("given", F.when(F.col("short"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * level_rate)))
        parent, above = children.select(*path, F.col("given").alias("budget")), path
    given = leaves.join(parent, list(LEVELS)).withColumn("budget", F.floor("budget").cast("long"))
    return given


def select_rows(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): one row for each time that a row of docs is taken."""
    rows = cut(token_table(docs))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    budget = cut(budgets(leaves, plan)).withColumn("whole", F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.lit(plan.epochs))).otherwise(0).cast("int")) \
        .withColumn("left", F.col("budget") - F.col("whole") * F.col("supply"))
    at = rows.join(budget, list(LEVELS))
    full = at.where("whole > 0").select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"))
    some = at.where(F.col("whole") < plan.epochs).withColumn("epoch", F.col("whole") + 1)
    some = some.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(plan.seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256))
    some = some.withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")).select("doc_id", *LEVELS, "n_tokens", "epoch", "h", "range", "left")
    sums = some.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("sum")).drop("sum")
    within = Window.partitionBy(*LEVELS, "range").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = some.withColumn("run", F.sum("n_tokens").over(within)).join(before, [*LEVELS, "range"]).where("before + run <= left")
    return full.unionByName(part.select("doc_id", *LEVELS, "n_tokens", "epoch"))


def mix_documents(docs: DataFrame, plan: Plan = STAGE_PLAN) -> DataFrame:
    """The rows of docs that the plan takes (once each), with their own columns."""
    taken = select_rows(docs, plan).select(F.col("doc_id").alias("taken")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"))  # no column of docs clashes with those added
    return own.join(taken, F.col("key").eqNullSafe(F.col("taken")), "left_semi").select("row.*")
