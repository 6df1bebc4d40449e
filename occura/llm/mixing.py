"""Mixing sources to target shares of all tokens, by hierarchical budgets and seeded epochs.

The leaves of a domain - language - source tree are the parts of each source in one domain and language; a
source's target share is split over its leaves as its tokens are, and an inner node weighs what its leaves weigh.
From the root down each node divides its budget among its children by weight. A child cannot take more than it
has (tokens times the source's allowed repeats); what it leaves goes to its siblings by weight, and only what all
siblings together cannot take goes up to their parent's siblings. A leaf then delivers whole epochs of its
documents and a prefix of one more, each epoch in its own seeded order.

Only the leaf table (targets times languages) reaches the driver. The prefix of an epoch is found from token sums
of hash buckets, then within one bucket, so a source with a third of all documents is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occura.llm.common import SMALL_ROWS

SEED = 20240117
#: Hash buckets of one leaf's epoch, 2**BUCKET_BITS.
BUCKET_BITS = 10


def water_fill(budget: float, weights: dict, room: dict) -> dict:
    """Divides ``budget`` by weight; what a full child leaves goes to the others by weight."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k, w in weights.items() if w > 0 and room[k] > 0}
    left = min(budget, sum(room[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / total >= room[k]}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= room[k] - given[k]
            given[k] = room[k]
        open_ -= full
    return given


def leaf_budgets(leaves: Iterable[tuple[tuple, float, float]], total: float) -> dict[tuple, float]:
    """Budget of every leaf; leaves are (path, weight, room), all paths of one length."""
    leaves = list(leaves)
    depth = len(leaves[0][0]) if leaves else 0

    def divide(prefix: tuple, budget: float) -> dict[tuple, float]:
        if len(prefix) == depth:
            return {prefix: budget}
        weights: dict[tuple, float] = {}
        room: dict[tuple, float] = {}
        for path, w, r in leaves:
            if path[: len(prefix)] == prefix:
                child = path[: len(prefix) + 1]
                weights[child] = weights.get(child, 0.0) + w
                # A leaf without weight is no target: its room helps nobody.
                room[child] = room.get(child, 0.0) + (r if w > 0 else 0.0)
        out: dict[tuple, float] = {}
        for child, b in water_fill(budget, weights, room).items():
            out |= divide(child, b)
        return out

    return divide((), total) if leaves else {}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, epoch, order_key, n_tokens): every delivery of a document, epochs counted from 0.

    ``documents``: doc_id, domain, lang, source, n_tokens (null language: 'und', null domain: ''). ``targets``:
    source, target_share, max_repeats; a source named twice keeps its largest share and repeats. The mix has
    ``total_tokens`` tokens (default: as many as the documents have), or fewer if the sources cannot give more.
    Sources without a target, and documents without tokens, are not delivered. The last document of a prefix is
    taken if at least half of it is within the budget.
    """
    spark = documents.sparkSession
    docs = documents.where("source IS NOT NULL AND n_tokens > 0").select("doc_id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"), "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = docs.join(F.broadcast(wanted.limit(SMALL_ROWS)) if targets.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else wanted, "source").groupBy("domain", "lang", "source", "target_share", "max_repeats").agg(F.sum("n_tokens").alias("available"))
    rows = have.collect()  # targets x languages
    if total_tokens is None:
        total_tokens = int(docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    per_source: dict[str, int] = {}
    for r in rows:
        per_source[r.source] = per_source.get(r.source, 0) + r.available
    budgets = leaf_budgets([((r.domain, r.lang, r.source), r.target_share * r.available / per_source[r.source], float(r.available) * r.max_repeats) for r in rows], float(total_tokens))
    leaves = []
    for r in rows:
        budget = budgets[(r.domain, r.lang, r.source)]
        epochs = min(int((budget + 1e-6) // r.available), r.max_repeats)
        part = budget - epochs * r.available if epochs < r.max_repeats else 0.0
        leaves.append((r.domain, r.lang, r.source, epochs, int(round(part))))
    leaf = F.broadcast(spark.createDataFrame(leaves, "domain string, lang string, source string, epochs int, part long"))

    own = docs.join(leaf, ["domain", "lang", "source"])
    order = lambda e: F.xxhash64(F.lit(seed), e, F.col("doc_id"))
    whole = own.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("order_key", order(F.col("epoch")))
    some = own.where("part > 0").withColumn("epoch", F.col("epochs")).withColumn("order_key", order(F.col("epoch"))).withColumn("bucket", F.shiftrightunsigned(F.col("order_key").bitwiseXOR(F.lit(-(2**63))), 64 - BUCKET_BITS))
    key = ["domain", "lang", "source"]
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = some.groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)))
    sums = sums.select(*key, "bucket", "before", "in_bucket")
    placed = some.join(sums, [*key, "bucket"]).where("before < part")
    inside = placed.where("before + in_bucket <= part")
    earlier = Window.partitionBy(*key, "bucket").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("before + in_bucket > part").withColumn("seen", F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).where("seen + n_tokens / 2 <= part")
    columns = ["doc_id", "source", "lang", "epoch", "order_key", "n_tokens"]
    return whole.select(*columns).unionByName(inside.select(*columns)).unionByName(edge.select(*columns))


def share_report(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, available_tokens, repeats): one row a target source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = mixed.agg(F.sum("n_tokens").alias("all_tokens"))
    have = documents.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long")).alias("available_tokens"))
    zero = F.lit(0).cast("long")
    return (
        targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
        .join(got, "source", "left").join(have, "source", "left").join(F.broadcast(total))
        .select("source", "target_share", F.round(F.coalesce("tokens", zero) / F.col("all_tokens"), 6).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"),
                F.coalesce("available_tokens", zero).alias("available_tokens"), F.round(F.coalesce(F.try_divide("tokens", "available_tokens"), F.lit(0.0)), 4).alias("repeats"))
    )
