"""Operator 9: mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree of domain, language and source. At each node it is shared
among the children by weight; no child gets more than it can hold (its tokens times ``epochs``),
and what it cannot take goes to its siblings by their weights. As a node's capacity is that of all below it, a
shortage is made good among siblings first, and by an ancestor's siblings only when they are full too.

A leaf with a budget of several times its tokens repeats whole epochs, then takes the longest
prefix that fits from one more epoch, in an order drawn by the md5 of seed, epoch and doc_id.
The prefix is found from sums over hash ranges of about ``RANGE_DOCS`` documents, so that no leaf is sorted in one
task; all that comes back to the documents is the last hash of each leaf's prefix; texts are shuffled only where there are over
``BROADCAST_LEAVES`` leaves.

Defined cases: null domain, language or source is ``unknown``; null and empty texts have no token
and ride along with any prefix that passes them. Rows that repeat a doc_id are ordered as one. An
empty table gives an empty result. Other columns are left as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.llm.common import checkpoint, table

LEVELS = ("_domain", "_lang", "_source")
RANGE_DOCS = 4096
# Documents of one leaf, of a hot source too, meet their leaf's row in this many parts.
_PARTS = 64
# The plan is broadcast up to so many rows (counted first), and joined in parts beyond.
BROADCAST_LEAVES = 100_000
# The domain of a source: by its number where its name ends in one.
DOMAIN = ("CASE WHEN try_cast(substring(source, 4) AS int) % 2 = 0 THEN 'web' WHEN try_cast(substring(source, 4) AS int) % 2 = 1 THEN 'curated'"
          " ELSE 'unknown' END")
WEIGHTS: tuple[Mapping[str, int], ...] = ({"web": 2, "curated": 3}, {"en": 4, "de": 2, "fr": 2, "es": 1}, {"src0": 1})
SHARE = (1, 2)
EPOCHS = 3


def tokens() -> Column:
    """A token for every four bytes of text, the last perhaps shorter."""
    return F.expr("(coalesce(octet_length(text), 0) + 3) DIV 4")


def _weight(level: int, weights: tuple[Mapping[str, int], ...]) -> Column:
    if any(not isinstance(w, int) or w < 1 for w in weights[level].values()):
        raise ValueError("weights are whole numbers above 0")
    out = F.lit(1)
    for value, weight in weights[level].items():
        out = F.when(F.col(LEVELS[level]) == value, F.lit(weight)).otherwise(out)
    return out.cast("decimal(20,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget``, the part of ``parent_budget`` that falls to each child of ``weight`` and ``cap``.

    Children are full from the one that fills first; the others share the rest by weight. All
    numbers are whole, so that a budget is rounded down.
    """
    filling = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name) if parent else Window.orderBy(F.col("cap") / F.col("weight"), name)
    whole = Window.partitionBy(*parent)
    so_far = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.expr("parent_budget - (cap_to - cap)")
    open_weight = F.expr("weight_all - (weight_to - weight)")
    return (children.withColumns({"cap_to": F.sum("cap").over(so_far), "weight_to": F.sum("weight").over(so_far), "weight_all": F.sum("weight").over(whole)})
            .withColumn("full", F.col("cap").cast("decimal(38,0)") * open_weight <= left.cast("decimal(38,0)") * F.col("weight"))
            .withColumns({"rest": F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)),
                          "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)})
            .withColumn("budget", F.expr("CASE WHEN full THEN cap ELSE (CAST(rest AS decimal(38,0)) * weight) DIV open END"))
            .drop("cap_to", "weight_to", "weight_all", "full", "rest", "open"))


def _with_leaf(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Documents with the columns of their leaf, each leaf's row standing once in every part."""
    part = F.pmod(F.xxhash64("doc_id", "_n"), F.lit(_PARTS)).cast("int")
    parted = leaves.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    return docs.withColumn("_part", part).join(parted, [*LEVELS, "_part"]).drop("_part")


def leaf_plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, seed: int = 0) -> DataFrame:
    """Per leaf ``(*LEVELS, epochs, last)``: its whole epochs, and the last hash of its prefix of
    the next (null if that is empty)."""
    rows = docs.select(*LEVELS, "doc_id", "_n", F.col("_n").alias("n"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).withColumn("cap", F.col("tokens") * epochs)
    nodes, above = leaves, []
    for level, name in enumerate(LEVELS):
        keys = [*above, name]
        children = nodes.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"),
                                            *([F.first("parent_budget").alias("parent_budget")] if level else []))
        if level == 0:  # the domains, a few rows
            every = Window.partitionBy()
            children = children.withColumn("parent_budget", F.least(F.sum("cap").over(every), F.expr(f"(sum(tokens) OVER () * {share[0]}) DIV {share[1]}")))
        shared = share_out(children.drop("tokens").withColumn("weight", _weight(level, weights)), above, name)
        nodes = nodes.drop("parent_budget").join(shared.select(*keys, F.col("budget").alias("parent_budget")), keys)
        above = keys
    leaves = nodes.select(*LEVELS, F.ceil(F.col("docs") / RANGE_DOCS).cast("long").alias("ranges"),
                          F.expr("CASE WHEN tokens > 0 THEN parent_budget DIV tokens ELSE 0 END").alias("epochs"),
                          F.expr("CASE WHEN tokens > 0 THEN parent_budget % tokens ELSE 0 END").alias("rest"))
    hashed = (_with_leaf(rows, leaves).withColumn("hash", _hash(seed))
              .withColumn("range", F.expr("shiftright(CAST(conv(substring(hash, 1, 8), 16, 10) AS long) * ranges, 32)")))
    sums = hashed.groupBy(*LEVELS, "range", "rest").agg(F.sum("n").alias("n"))
    ranges = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.withColumn("before", F.sum("n").over(ranges) - F.col("n")).where("before <= rest").select(*LEVELS, "range", "before")
    within = Window.partitionBy(*LEVELS, "range").orderBy("hash")  # rows of one hash come together
    taken = (hashed.join(before, [*LEVELS, "range"]).withColumn("upto", F.col("before") + F.sum("n").over(within))
             .where("upto <= rest").groupBy(*LEVELS).agg(F.max("hash").alias("last")))
    return leaves.select(*LEVELS, "epochs").join(taken, list(LEVELS), "left")


def _hash(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, seed: int = 0, domain: str = DOMAIN,
                size: Column | None = None) -> DataFrame:
    """Adds ``domain`` and ``copies``, how often a document stands in the mix (0: not at all); columns of
    these names are replaced. ``size`` is a document's number of tokens (default: ``tokens()``)."""
    rest = [c for c in docs.columns if c not in ("domain", "copies")]
    placed = docs.select(F.struct(*rest).alias("_row"), "doc_id", F.coalesce(F.expr(domain), F.lit("unknown")).alias("_domain"),
                         F.coalesce("lang", F.lit("unknown")).alias("_lang"), F.coalesce("source", F.lit("unknown")).alias("_source"),
                         (tokens() if size is None else size).alias("_n"))
    plan = checkpoint(leaf_plan(placed, weights, share, epochs, seed))
    few = plan.count() <= BROADCAST_LEAVES
    out = placed.join(F.broadcast(plan), list(LEVELS)) if few else _with_leaf(placed, plan)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_domain").alias("domain"),
                      (F.col("epochs") + F.coalesce((_hash(seed) <= F.col("last")).cast("long"), F.lit(0))).alias("copies"))


def op9_mixing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tokens().alias("n_tokens"))
    return mix_sources(docs, size=F.col("n_tokens")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")
