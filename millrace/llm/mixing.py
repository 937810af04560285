"""Mixing sources to target weights (problem 8).

Hierarchical budgeting: the leaves of a domain-language-source tree are the named sources, a node's weight is
the sum of its leaves' target shares, and budgets go down the tree. Where a child can't use its budget, because its
documents times their repeats run out, the rest goes to its siblings, and only what a whole subtree can't use
goes to the siblings of an ancestor. Each leaf then takes whole epochs and a token-prefix of one more, each
epoch in its own seeded order, and of the documents after the prefix the one that fills the rest best.

Without a total, the mix is the largest one in which no source that has documents falls short.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import broadcast_if_small, materialize
from .tokens import encode_corpus

#: Parts of an epoch's order whose sizes are summed before the one that holds the cut is looked at closely.
BINS = 1 << 16
#: Named sources, whose budgets are worked out on the driver.
MOST_SOURCES = 100_000


KEPT = ["doc_id", "source", "epoch", "n_tokens"]


@dataclass
class Node:
    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def allocate(node: Node, budget: float, out: dict[str, float], path: str = "") -> None:
    """Share a budget among a node's children by weight; what a child can't use goes to its siblings."""
    if not node.children:
        out[node.name] = min(budget, node.capacity)
        return
    budget = min(budget, node.capacity)
    given = dict.fromkeys(node.children, 0.0)
    open_, left = {k for k, c in node.children.items() if c.weight > 0 and c.capacity > 0}, budget
    while open_ and left > 1e-9 * max(1.0, budget):
        weight = sum(node.children[k].weight for k in open_)
        full = {k for k in open_ if given[k] + left * node.children[k].weight / weight >= node.children[k].capacity}
        if not full:
            for k in open_:
                given[k] += left * node.children[k].weight / weight
            break
        for k in sorted(full):
            left -= node.children[k].capacity - given[k]
            given[k] = node.children[k].capacity
        open_ -= full
    for k, child in node.children.items():
        allocate(child, given[k], out)


def budgets(leaves: list[tuple[tuple[str, ...], str, float, float]], total: float | None = None) -> dict[str, float]:
    """Tokens for each source, from (path of ancestors, source, share, capacity)."""
    if not leaves:
        return {}

    def tree(capacity) -> Node:
        root = Node("")
        for path, source, share, most in leaves:
            node = root
            for step in (*path, source):
                node.weight += share
                node.capacity += capacity(most)
                node = node.children.setdefault(step, Node(step))
            node.name, node.weight, node.capacity = source, share, capacity(most)
        return root

    if total is None:
        shares: dict[str, float] = {}
        allocate(tree(lambda most: 1.0 if most > 0 else 0.0), 1.0, shares)
        fits = [most / shares[source] for _, source, _, most in leaves if most > 0 and shares.get(source, 0) > 0]
        total = min(fits, default=0.0)
    out: dict[str, float] = {}
    allocate(tree(float), total, out)
    return out


def _leaves(sized: DataFrame, targets: DataFrame) -> list:
    """Each named source with its language, its tokens and documents; a source without documents too."""
    have = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    have = have.groupBy("source").agg(
        F.max_by("lang", F.struct("docs", "lang")).alias("lang"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")
    )
    rows = targets.join(have, "source", "left").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} named sources")
    return rows


def sized_documents(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of the named sources' documents that have tokens."""
    named = docs.join(broadcast_if_small(targets.select("source").distinct()), "source", "left_semi")
    sizes = encode_corpus(named.select("doc_id", "text"), path=path).select("doc_id", F.size("ids").alias("n_tokens"))
    lang = F.lower(F.trim(F.substring_index(F.substring_index(F.coalesce("lang", F.lit("")), "-", 1), "_", 1)))
    about = named.select("doc_id", "source", F.when(lang == "", "und").otherwise(lang).alias("lang"))
    return about.join(sizes.filter("n_tokens > 0"), "doc_id").dropDuplicates(["doc_id"])


def _prefix(part: DataFrame) -> DataFrame:
    """(doc_id, source, epoch, n_tokens): of each source's documents (..., at, rest) in the order of ``at``, the longest beginning
    that has at most ``rest`` tokens. Bins of the order are summed first, so that only the one with the cut is sorted."""
    part = part.withColumn("bin", F.shiftrightunsigned("at", 48).cast("int"))
    bins = part.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")
    part = part.join(bins.select("source", "bin", "n", before.alias("before")), ["source", "bin"])
    below = part.filter(F.col("before") + F.col("n") <= F.col("rest"))
    cut = part.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    so_far = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("at", "doc_id"))
    cut = cut.withColumn("so_far", so_far).filter(F.col("so_far") <= F.col("rest"))
    return materialize(below.select(KEPT).unionByName(cut.select(KEPT)))


def mix_sources(
    docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the mix (doc_id, source, epoch, n_tokens), a row for each use of a document, and the report
    (source, target_share, budget, tokens, share, documents, uses, most_uses).

    A document without text or tokens is in no mix; a target that is null, negative or zero takes nothing, and a
    null ``max_repeats`` counts as 1. Of several rows for one source, the one with the largest share counts.
    """
    targets = targets.select("source", "target_share", "max_repeats").filter("source is not null")
    targets = targets.groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t"))
    targets = targets.select("source", F.greatest("t.s", F.lit(0.0)).alias("target_share"), F.greatest("t.r", F.lit(0)).alias("max_repeats"))
    sized = materialize(sized_documents(docs, targets, path))
    rows = _leaves(sized, targets)
    plan = budgets(
        [((r["source"].partition(".")[2], r["lang"] or "und"), r["source"], r["target_share"], float((r["tokens"] or 0) * r["max_repeats"])) for r in rows],
        total,
    )
    spark = docs.sparkSession
    wanted = []
    for r in rows:
        tokens, budget = r["tokens"] or 0, plan.get(r["source"], 0.0)
        whole = min(int((budget + 1e-6) // tokens), r["max_repeats"]) if tokens else 0
        rest = max(0.0, budget - whole * tokens) if whole < r["max_repeats"] else 0.0
        wanted.append((r["source"], r["target_share"], budget, whole, rest))
    wanted = broadcast_if_small(spark.createDataFrame(wanted, "source string, target_share double, budget double, whole int, rest double"))

    each = sized.join(wanted, "source")
    full = each.filter("whole > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), "n_tokens")
    order = F.xxhash64(F.lit(seed), "whole", "doc_id")
    part = each.filter("rest > 0").select("doc_id", "source", F.col("whole").alias("epoch"), "n_tokens", "rest", order.alias("at"))
    taken = _prefix(part)
    # a long document at the cut is passed over once: the order goes on with those that fit into what is left
    for last in (False, True):
        got = taken.groupBy("source").agg(F.sum("n_tokens").alias("got"))
        gap = wanted.filter("rest > 0").join(got, "source", "left").select("source", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap"))
        after = part.join(broadcast_if_small(gap), "source").join(taken.select("doc_id"), "doc_id", "left_anti")
        if not last:
            fit = after.filter("n_tokens <= gap").drop("rest").withColumnRenamed("gap", "rest")
            taken = materialize(taken.unionByName(_prefix(fit)))
    # then the one document that fills the rest best, if it brings the source nearer
    miss = F.abs(F.col("n_tokens") - F.col("gap"))
    best = after.filter(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "at", "doc_id", "epoch", "n_tokens")).alias("b"))
    last = best.select("b.doc_id", "source", "b.epoch", "b.n_tokens")
    mix = materialize(full.select(KEPT).unionByName(taken).unionByName(last))

    used = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    used = used.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    every = mix.agg(F.sum("n_tokens").alias("every"))
    report = wanted.select("source", "target_share", "budget").join(used, "source", "left").crossJoin(F.broadcast(every))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("share")
    return mix, report.select("source", "target_share", "budget", zero("tokens"), share, zero("documents"), zero("uses"), zero("most_uses"))
